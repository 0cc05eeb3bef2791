import pytest

#: Names that operators use inside or return, as further columns of the input.
CLASH = "id key no fp size n copies digest hash rate target source_size piece start length task rank kept group_size keep_id drop lines block held_out score words k h place runs repeats gone row _x_id _x_key _x_h2 _x_digest _x_size _x_keep _x_words _X_copies".split()

BASE = " ".join(f"word{i} of line" for i in range(30))
SHARED = " ".join(f"shared{i}" for i in range(25))
LONG = "\n".join(" ".join(f"w{(i * 7 + k * k) % 9973}" for k in range(12)) for i in range(9000))

DOCS = [
    (1, BASE, "aa", "web", 1),
    (2, BASE, "aa", "web", 1),
    (2, BASE, "aa", "web", 1),
    (None, BASE, "aa", "web", None),
    (3, None, "aa", None, None),
    (4, "", None, "web", 0),
    (5, " \t\n\x0b ", "bb", "", 0),
    (6, LONG, "bb", "books", 1),
    (7, LONG + " tail", None, "books", 1),
    (8, f"{BASE}\n{SHARED}\nsome more words here", "bb", "news", 1),
    (9, f"opening words first\n{SHARED}\n{SHARED}\nÄ Ö <|im_end|> 　 \x1c end", "bb", None, 1),
    (10, "12 34 !? --", "aa", "news", 1),
    (None, None, None, None, None),
    (11, "\n\n\n", "aa", "web", 1),
    (9, "another text with the same id as one before", "bb", "news", 1),
    (12, "é" * 70_000, "bb", "news", 1),
]


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    return plain.withColumns({c: F.lit("other") for c in CLASH}).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0).cache()


@pytest.fixture(scope="session")
def real(spark, sf):
    """(doc_id, text, lang, source) of all documents."""
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="session")
def query(spark, sf):
    from declarium.llm.queries import QUERIES

    made = {}

    def run(name):
        if name not in made:
            made[name] = QUERIES[name](spark, sf).toPandas()
        return made[name]

    return run
