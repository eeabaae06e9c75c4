"""Small tables with the odd cases every operator must bear, and a limit on broadcasts."""

from contextlib import contextmanager

ODD_TEXTS = [None, "", " ", "\n\n", "a", "one two", "tie tie tie", "x  y\t z\n\n w",
             "word " * 3000, "é" * 5000, "Ünïcode größe  Ça va?", "<|endoftext|> 1 2  3",
             "line one is here\nline two is here\nline one is here",
             "mail a.b@c.d.e+f@g.h or 1.2.3.4.5.6.7.8 or 4111 1111 1111 1111 or +1 (555) 010-9999."]


def odd_documents(spark, clash=True):
    """Odd texts, twice over, with repeated rows, null ids and columns that clash."""
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(ODD_TEXTS * 2)]
    rows += [rows[3], rows[3], (None, "a null id", None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if clash:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit(7) for c in ("fp", "key", "rid", "pos", "n", "value", "cue",
                                                   "line", "first", "component", "seg", "start", "y",
                                                   "h", "p", "rate", "term", "a", "b", "size")})
    return df


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@contextmanager
def broadcast_limit(spark, planned, most):
    """Tables that Spark takes for smaller than `planned` are broadcast as on a large input;
    one whose hash table is larger than `most` fails the query."""
    named = {"spark.sql.autoBroadcastJoinThreshold": planned, "spark.sql.maxBroadcastTableSize": most}
    before = {k: spark.conf.get(k) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
