"""Small inputs with every awkward case, for the operator tests."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

SYLLABLES = "the ra ing on é ß tion os ción 中 re an".split()


def prose(rng, n, vocab=60):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(1 + k % 4)) + str(k % 7) * (k % 5 == 0) for k in range(vocab)]
    out = []
    for i in range(n):
        out.append(rng.choice(words))
        if i % 9 == 8:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


def awkward(seed=1, n=40):
    """(doc_id, text) rows: nulls, empty and blank texts, a very long one, exact
    and near copies, repeated rows, rows sharing an id, and negative ids."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([3, 9, 25, 60, 150]), 4000)) for i in range(n)]
    base = prose(rng, 120, 4000)
    near = base.split(" ")
    near[60] = "changed"
    rows += [(100, base), (101, base), (102, " ".join(near)), (103, base + " and one more line.")]
    rows += [(110, None), (111, ""), (112, " \t\n "), (113, "a"), (114, "\n\na\n\na\n"), (115, "Don't! it's 12 34 <|endoftext|> İ")]
    rows += [(120, prose(rng, 30_000, 9000)), (121, "x" * 70_000), (122, "word " * 50)]
    rows += [(130, "the same row twice over"), (130, "the same row twice over"), (131, "one text"), (131, "another text")]
    rows += [(None, "a text without an id"), (None, None), (-5, "a negative id")]
    return rows


def table(spark, rows, **extra):
    """The documents table of (doc_id, text) rows, with extra columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", None if i == 3 else "src1", None if t is None else len(t)) for i, t in rows], DOCS)
    return df.select("*", *[F.lit(v).alias(k) for k, v in extra.items()])


def same(got, want):
    """Rows as sorted lists are equal."""
    order = (lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, (list, dict)) else (False, "", str(x)) for x in r))
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
