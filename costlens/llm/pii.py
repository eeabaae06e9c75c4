"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Everything is column expressions and joins. Match places come from splitting a
text at a pattern: gaps and matches alternate, so ends are running sums of lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costlens.llm.quality import let
from costlens.llm.tables import prepare, stage

#: The patterns of the four kinds. Possessive repeats match the same
#: text as greedy ones here, without backtracking or deep recursion; a match that
#: cannot begin inside a run of its first class begins at its start or where the
#: match before it ended.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
         r"(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
CHUNK = 128

#: A cue word, what separates it, and an identifier-like token with a digit.
TOKEN = (r"(?:\+[0-9][ ().0-9-]{5,}[0-9]"
         r"|(?=[A-Za-z._%@+-]{0,64}+[0-9])[A-Za-z0-9][A-Za-z0-9._%@+-]{4,}[A-Za-z0-9])")
CUE = r"(?<!\p{L})\p{L}{1,30}+(?:[ \t]{0,4}[:=#][ \t]{0,4}[\"']?|[ \t]{1,4}[\"']?)"
#: A seed besides the four kinds: a long hexadecimal secret.
SECRET = r"^[0-9a-f]{16,}$"


def running(lengths: Column) -> Column:
    """Running sums of an array, chunk by chunk: linear time for any length."""
    def of(steps: Column) -> Column:
        chunk = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int"))

        def added(part: Column, base: Column) -> Column:
            return F.aggregate(part, F.struct(base.alias("s"), F.array().cast("array<long>").alias("a")),
                               lambda acc, x: F.struct((acc["s"] + x).alias("s"),
                                                       F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")))["a"]

        def piece(k: Column) -> Column:
            return F.slice(steps, k * CHUNK + 1, F.lit(CHUNK))

        totals = F.transform(chunk, lambda k: F.aggregate(
            piece(k), F.lit(0).cast("long"), lambda s, x: s + x))
        bases = F.concat(F.array(F.lit(0).cast("long")), added(totals, F.lit(0).cast("long")))
        return let(bases, lambda b: F.flatten(F.transform(
            chunk, lambda k: added(piece(k), F.get(b, k)))))

    empty = F.array().cast("array<long>")
    return let(lengths, lambda steps: F.when(F.size(steps) == 0, empty).otherwise(of(steps)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<value, start, stop>>: leftmost non-overlapping matches, code points."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pair: Column) -> Column:
        m = pair["m"]
        steps = F.transform(m, lambda v, i: (F.length(F.get(pair["g"], i)) + F.length(v)).cast("long"))
        return F.zip_with(m, running(steps), lambda v, e: F.struct(
            v.alias("value"), (e - F.length(v)).alias("start"), e.alias("stop")))

    return let(F.struct(gaps.alias("g"), found.alias("m")), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def doubled(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0),
                       lambda s, i: s + doubled(i)) % 10 == 0


def valid_ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.concat(F.lit("0"), F.substring(bare, 1, 3)).cast("int") <= 255)
    return F.forall(F.split(value, r"\."), small)


def valid_card(value: Column) -> Column:
    n = digits(value)
    return F.when(F.length(n).between(13, 19), luhn(n)).otherwise(F.lit(False))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind; a match that fails its check is dropped, not retried."""
    none = F.array().cast("array<struct<value:string,start:bigint,stop:bigint>>")

    def kind(needs: Column, pattern: str, check=None) -> Column:
        found = matches(text, pattern)
        if check is not None:
            found = F.filter(found, lambda s: check(s["value"]))
        return F.when(needs, found).otherwise(none)

    number = text.rlike("[0-9]")
    return {"email": kind(F.contains(text, F.lit("@")), EMAIL),
            "ip": kind(number, IP, valid_ip), "card": kind(number, CARD, valid_card),
            "phone": kind(F.contains(text, F.lit("+")), PHONE,
                          lambda v: F.length(digits(v)).between(9, 15))}


def cue_of(match: Column) -> Column:
    """Lower-case cue word and separator of a match, inner blanks as one."""
    cue = F.regexp_extract(match, f"^({CUE})", 1)
    return F.lower(F.regexp_replace(cue, "[ \\t]+", " "))


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, cue, value, start, stop, seed): candidate tokens with their cue."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.where(t.rlike("[0-9]")).select(
        "doc_id", F.xxhash64(t).alias("text_hash"),
        F.explode(matches(t, CUE + TOKEN)).alias("m"))
    rows = rows.withColumn("cue", cue_of(F.col("m.value"))).withColumn(
        "value", F.regexp_extract("m.value", f"^{CUE}(.*)$", 1))
    value = F.col("value")
    known = (value.rlike(f"^(?:{EMAIL})$") | (value.rlike(f"^(?:{IP})$") & valid_ip(value))
             | valid_card(value) & value.rlike("^[0-9][0-9 -]*$")
             | value.rlike(f"^(?:{PHONE})$") & F.length(digits(value)).between(9, 15))
    return rows.select("doc_id", "text_hash", "cue", "value",
                       (F.col("m.stop") - F.length("value")).alias("start"),
                       F.col("m.stop").alias("stop"), known.alias("known"),
                       (known | value.rlike(SECRET)).alias("seed"))


def confident_cues(found: DataFrame, rounds: int = 3, support: int = 5,
                   confidence: float = 0.8) -> DataFrame:
    """(cue, score): patterns whose instances are mostly trusted, scored in rounds.

    The graph joins each cue to its distinct values. A cue's score is the trusted
    share of its values, smoothed towards zero; a value's trust is 1 for seeds, else
    its best confident cue's score. Each round is two aggregations, combined before
    they are shuffled. A confident cue needs `support` trusted values.
    """
    edges = stage(found.groupBy("cue", "value").agg(F.max("seed").alias("seed")), "cue-values")
    trusted = edges.select("cue", "value", "seed", F.col("seed").cast("double").alias("trust"))
    for i in range(rounds):
        cues = trusted.groupBy("cue").agg(
            F.sum("trust").alias("support"), F.count(F.lit(1)).alias("n"))
        good = stage(cues.select("cue", "support", (F.col("support") / (F.col("n") + 1))
                                 .alias("score")).where(
            (F.col("support") >= support) & (F.col("score") >= confidence)), "cues")
        if i < rounds - 1:
            best = edges.join(good, "cue").groupBy("value").agg(F.max("score").alias("best"))
            trusted = edges.join(best, "value", "left").select(
                "cue", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(
                    F.coalesce("best", F.lit(0.0))).alias("trust"))
    return good.select("cue", "score")


def extract(docs: DataFrame, text: str = "text", rounds: int = 3, support: int = 5,
            confidence: float = 0.8) -> DataFrame:
    """`docs` with `_base` (kind -> spans) and `_more` (spans that contexts found).

    Spans are structs of value, start and stop in code points. `_more` holds tokens
    behind confident cues that are of none of the base kinds. Null texts count as
    empty; rows equal in doc_id and text are alike; no rows give none; other columns
    pass through (names that begin with an underscore are reserved).
    """
    prepare(docs.sparkSession)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = stage(occurrences(docs, text), "occurrences")
    cues = confident_cues(found, rounds, support, confidence)
    more = (found.where(~F.col("known")).join(cues, "cue")
            .groupBy("doc_id", "text_hash")
            .agg(F.array_sort(F.collect_set(F.struct("start", "stop", "value"))).alias("_more"))
            .select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_more"))
    base = F.struct(*[c.alias(k) for k, c in base_spans(t).items()])
    rows = docs.withColumns({"_base": base, "_key": F.xxhash64(t)})
    joined = rows.join(more, F.col("doc_id").eqNullSafe(F.col("_doc"))
                       & (F.col("_key") == F.col("_hash")), "left")
    return joined.drop("_doc", "_hash", "_key")


def written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(
        ":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))
