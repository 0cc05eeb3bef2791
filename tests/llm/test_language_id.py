import zlib

import brute
import numpy as np
from conftest import DOCS

from declarium.llm import language_id as li


def test_contract_and_held_out_accuracy(query, real):
    got = query("op2_language_id").set_index("doc_id")
    known = {lang for _, _, lang, _ in real if lang}
    right = total = 0
    assert len(got) == len(real)
    for i, text, lang, _ in real:
        row = got.loc[i]
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= row["score"] <= 1
        letters = any(c.isalpha() for c in text or "")
        assert row["lang_pred"] in known if letters else row["lang_pred"] == "und"
        if row["held_out"] and lang and letters and len(brute.words(text)) >= 20:
            total, right = total + 1, right + (row["lang_pred"] == lang)
    assert total >= 20 and right / total >= 0.97


def test_models_are_interpolated_kneser_ney():
    texts = {"aa": ["abra cadabra", "a bad cab"], "bb": ["hocus pocus", "focus"]}
    counts = {}
    for lang, own in texts.items():
        u = li.units(own)
        counts[lang] = tuple(np.unique(li._grams(u)[u[3:] != 0], return_counts=True))
    models = li.fit(counts)
    alphabet = sorted({x for own in texts.values() for u in [li.units(own)] for x in u[u != 0].tolist()})
    for j, lang in enumerate(models.langs):
        u = li.units(texts[lang]).tolist()
        slow = brute.KneserNey([tuple(u[i - 3 : i + 1]) for i in range(3, len(u)) if u[i]], 4, len(alphabet) + 1)
        for context in [(0, 0, 0), (0, 0, 97), (97, 98, 114), (99, 117, 115), (120, 120, 120)]:
            grams = np.array([sum(x << (16 * (3 - k)) for k, x in enumerate((*context, c))) for c in [*alphabet, 0x7A7A]], np.uint64)
            p = np.exp(models.logs(grams)[:, j].astype(float))
            assert np.allclose(p, [slow.p((*context, c)) for c in [*alphabet, 0x7A7A]], rtol=1e-4)
            assert abs(p.sum() - 1) < 1e-4


def test_tables_are_sorted_and_found():
    keys = np.arange(1, 2000, 3, dtype=np.uint64)
    table = li.Table.of(keys, keys.astype(np.float32))
    assert (table.hashes[1:] > table.hashes[:-1]).all()
    at, there = table.find(np.arange(2000, dtype=np.uint64))
    assert (there == (np.arange(2000) % 3 == 1)).all() and (table.values[at[there]] == keys).all()


def test_edge_cases(docs, none):
    models = li.train(docs, "doc_id", "text", "lang")
    rows = li.predict(docs, models).collect()
    assert len(rows) == len(DOCS)
    by = {r.id: r for r in rows if r.id not in (None, 9)}
    for i in (3, 4, 5, 10, 11):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[1][1:] == by[2][1:] and by[1].lang_pred in ("aa", "bb")
    assert li.predict(none, models).collect() == []
    untaught = li.train(none, "doc_id", "text", "lang")
    assert {r.lang_pred for r in li.predict(docs, untaught).collect()} == {"und"}


def test_foreign_text_is_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = li.train(docs, "doc_id", "text", "lang")
    _, _, rejected = models.predict(["κατάλογος των εγγράφων που δεν ανήκουν σε καμία γλώσσα " * 5, "zxqj vkqz wqx jjqk zzxv " * 20])
    assert rejected.all()
