import brute
from conftest import DOCS

from declarium.llm import quality


def test_all_documents(query, real):
    want = brute.quality([(i, t, s) for i, t, _, s in real])
    names = ["doc_id", *quality.MEASURES, "base_failed", "n_removed_words", "kept"]
    got = sorted(tuple(int(x) for x in r) for r in query("op4_quality_rules")[names].itertuples(index=False))
    assert got == sorted(tuple(int(x) for x in (k[0], *v[:6], v[6], v[7])) for k, v in want.items())


def test_edge_cases(docs, none):
    rows = quality.verdicts(docs).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        texts = {d[1] for d in DOCS if d[0] == r.id}
        assert tuple(r[k] for k in quality.MEASURES) in {brute.base_rules(t) for t in texts}
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.apply(docs).columns == docs.columns
    assert quality.verdicts(none).collect() == [] and quality.apply(none).collect() == []


def test_frequent_lines_go(spark):
    menu = "Home | About | Contact and all the other pages"
    body = lambda i: " ".join(f"d{i}w{k}" for k in range(60))
    rows = [(i, f"{menu if i % 2 else menu.upper()}\n{body(i)}", "a.example") for i in range(40)]
    rows += [(100, body(100), "a.example"), (101, "\n".join([menu, "many of these words " + " ".join(f"x{k}" for k in range(50))]), "b.example")]
    rows += [(102, f"{body(102)}\n" + "\n".join(" ".join(f"f{j}w{k}" for k in range(40)) for j in range(3)), "a.example")]
    rows += [(200 + i, f"{' '.join(f'g{i}w{k}' for k in range(5))}\n" + "\n".join(" ".join(f"f{j}w{k}" for k in range(40)) for j in range(3)), "a.example") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = brute.quality(rows)
    got = {r.id: (*[r[k] for k in quality.MEASURES], r.base_failed, r.n_removed_words, r.kept) for r in quality.verdicts(df).collect()}
    assert got == {k[0]: v for k, v in want.items()}
    assert got[1][6] == 10 and got[0][6] == 0 and got[101][6] == 0 and not got[210][7] and got[102][7]
    kept = {r.doc_id: r.text for r in quality.apply(df).collect()}
    assert kept[0] == rows[0][1] and kept[1] == body(1) and kept[101] == rows[41][1] and 210 not in kept


def test_copies_count_once(spark):
    text = "\n".join(" ".join(f"l{j}w{k}" for k in range(12)) for j in range(6))
    df = spark.createDataFrame([(i, text, "a") for i in range(60)], "doc_id bigint, text string, source string")
    assert all(r.kept and not r.n_removed_words for r in quality.verdicts(df).collect())
