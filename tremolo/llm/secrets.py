"""Secret scans with character Markov models (operator 2), DataFrame functions only.

Base spans come from three patterns (assignments, access keys, long hex runs). The method
adds the tokens that look random: two first-order Markov models over the token alphabet,
one of random strings and one of ordinary identifiers, are compared by their
log-likelihood ratio per transition.

Training samples are labelled: the ordinary ones are the tokens of ``TRAIN_DOCS`` texts (about; chosen
by a hash of id and text, a repeated text once) outside any base match; the random ones are digests of
those documents in hex, base64 and upper-case spelling, and the keys and hex runs found in
them. The model is a table of ``CLASSES`` squared ratios whatever the corpus.

Scale: base and token spans are one map over the documents in generated code and
higher-order functions, no shuffle and no Python. Positions are running sums of piece lengths,
taken in chunks of ``CHUNK`` matches so that a text with very many matches stays linear.

Cases: a null or empty text has no span; with no token to learn from every ratio is 0 and
nothing is added; repeated rows are scanned alike and weigh in the sample once; input columns that clash with the new ones are replaced; empty tables give empty
results. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.llm.common import cut

ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
#: as greedy runs, the patterns with a least length find exactly the runs long enough
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
MIN_VALUE = 6

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CLASSES = len(ALPHABET) + 1  # 0: any other character
TRAIN_DOCS = 2_000
DIGESTS = 4  # random strings of each spelling made from a training document
ALPHA = 0.5  # added to every transition count
THRESHOLD = 0.5  # mean log ratio of a transition, natural logarithm
CHUNK = 256


def _zero() -> Column:
    return F.lit(0).cast("long")


def add_spans(docs: DataFrame, patterns: dict[str, str], ok: dict) -> DataFrame:
    """``docs`` with one array<struct<start, no, kind, end>> column per kind: the matches of
    its pattern in the whole text that pass ``ok[kind]`` (all if there is none).

    A match starts after all pieces up to it and all matches before it. Each step is a
    projection of its own whose result the next one uses more than once, so that the optimizer
    keeps the steps apart and a pattern runs over a text twice (matches, pieces) only.
    """
    text = F.coalesce("text", F.lit(""))
    name = "_{}_{}".format
    out = docs.drop(*patterns).withColumns({name("m", k): F.regexp_extract_all(
        text, F.lit(p), F.lit(0)) for k, p in patterns.items()})

    def sized(k: str, p: str) -> Column:
        found = F.col(name("m", k))
        return F.when(F.size(found) > 0, F.zip_with(
            F.slice(F.split(text, p, -1), 1, F.size(found)), found, lambda gap, m: F.struct(
                F.char_length(gap).cast("long").alias("gap"),
                F.char_length(m).cast("long").alias("n"),
                (ok[k](m) if k in ok else F.lit(True)).alias("ok"))))

    out = out.withColumns({name("z", k): sized(k, p) for k, p in patterns.items()})

    def chunked(k: str) -> Column:
        z = F.col(name("z", k))
        pairs = "array<struct<start:bigint,end:bigint>>"

        def add(a, x):
            start = a["at"] + x["gap"]
            end = start + x["n"]
            one = F.array(F.struct(start.alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(x["ok"], F.concat(a["spans"], one)).otherwise(
                a["spans"]).alias("spans"))

        starts = F.sequence(F.lit(1), F.size(z), F.lit(CHUNK))
        return F.when(F.size(z) > 0, F.transform(starts, lambda c: F.aggregate(
            F.slice(z, c, F.lit(CHUNK)),
            F.struct(_zero().alias("at"), F.array().cast(pairs).alias("spans")), add)))

    out = out.withColumns({name("c", k): chunked(k) for k in patterns})

    def placed(k: str) -> Column:
        chunks = F.col(name("c", k))
        bases = F.aggregate(chunks, F.array(_zero()), lambda a, x: F.concat(a, F.array(
            F.element_at(a, -1) + x["at"])))  # where each chunk begins
        return F.when(F.size(chunks) > 0, F.flatten(F.zip_with(
            F.slice(bases, F.lit(1), F.size(chunks)), chunks, lambda b, x: F.transform(
                x["spans"], lambda s: F.struct(
                    (s["start"] + b).alias("start"), F.lit(KINDS.index(k)).alias("no"),
                    F.lit(k).alias("kind"), (s["end"] + b).alias("end")))))).otherwise(
            F.array().cast(SPANS))

    out = out.withColumns({k: placed(k) for k in patterns})
    return out.drop(*[name(x, k) for x in "mzc" for k in patterns])


KINDS = ("assign", "access", "hex", "markov")
SPANS = "array<struct<start:bigint,no:int,kind:string,end:bigint>>"


PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": TOKEN}


def long_enough(match: Column) -> Column:
    return F.char_length(F.regexp_extract(match, "^" + ASSIGN, 2)) >= MIN_VALUE


def _class(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def transitions(samples: DataFrame) -> DataFrame:
    """is_random, a, b, n: counts of neighbouring characters (as classes) in the samples."""
    pair = samples.where(F.char_length("token") > 1).select("is_random", F.explode(F.transform(
        F.sequence(F.lit(1), F.char_length("token") - 1),
        lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("pair"))
    return pair.groupBy("is_random", "pair").agg(F.count("*").alias("n")).groupBy(
        "is_random", F.expr(f"instr('{ALPHABET}', substr(pair, 1, 1))").alias("a"),
        F.expr(f"instr('{ALPHABET}', substr(pair, 2, 1))").alias("b")).agg(F.sum("n").alias("n"))


def log_ratios(samples: DataFrame) -> list[float]:
    """log P_random(b | a) - log P_ordinary(b | a) at a * CLASSES + b."""
    counts = transitions(samples).withColumn(
        "row", F.sum("n").over(Window.partitionBy("is_random", "a")))
    smooth = F.log((F.col("n") + ALPHA) / (F.col("row") + ALPHA * CLASSES))
    unseen = F.log(F.lit(ALPHA) / (F.col("row") + ALPHA * CLASSES))
    seen = {(r.is_random, r.a, r.b): r.p for r in counts.select(
        "is_random", "a", "b", smooth.alias("p")).collect()}  # at most 2 * CLASSES ** 2 rows
    floor = {(r.is_random, r.a): r.p for r in counts.select(
        "is_random", "a", unseen.alias("p")).distinct().collect()}
    if not floor:
        return [0.0] * CLASSES ** 2
    flat = -F.log(F.lit(float(CLASSES)))  # a class never seen says nothing
    nothing = samples.sparkSession.range(1).select(flat).first()[0]

    def p(kind, a, b):
        return seen.get((kind, a, b), floor.get((kind, a), nothing))

    return [round(p(True, a, b) - p(False, a, b), 4) for a in range(CLASSES)
            for b in range(CLASSES)]


def training_samples(docs: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """token, is_random: labelled samples from about ``limit`` texts chosen by a hash of id and text;
    rows that repeat one are one, so rows without an id or with the same one are sampled like any others."""
    total = docs.count()
    share = max(1, -(-total // limit))
    mine = cut(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select(
        F.coalesce("text", F.lit("")).alias("text")).distinct())
    plain = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    ordinary = mine.select(F.explode(F.regexp_extract_all(
        plain, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("token"))
    digest = F.sha2("seed", 256)
    coded = F.base64(F.unhex(digest))
    seeds = mine.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(DIGESTS)), lambda i: (
        F.concat_ws(":", F.md5("text"), i.cast("string"))))).alias("seed"))
    random = seeds.select(F.explode(F.array(
        digest, coded, F.upper(F.translate(coded, "+/=", "XYZ")))).alias("token"))
    found = mine.select(F.explode(F.concat(
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))).alias("token"))
    return ordinary.withColumn("is_random", F.lit(False)).unionByName(
        random.unionByName(found).withColumn("is_random", F.lit(True)))


def looks_random(ratios: list[float], threshold: float = THRESHOLD):
    """Test of a token: does its mean log ratio reach the threshold?"""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")

    def test(token: Column) -> Column:
        steps = F.char_length(token) - 1
        total = F.aggregate(F.sequence(F.lit(1), steps), F.lit(0.0), lambda a, i: a + F.element_at(
            table, (_class(F.substring(token, i, F.lit(1))) * CLASSES
                    + _class(F.substring(token, i + 1, F.lit(1))) + 1).cast("int")))
        return total >= threshold * steps

    return test


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with base spans (assign, access, hex) and markov, the spans that look random."""
    ratios = log_ratios(training_samples(docs))
    return add_spans(docs, PATTERNS, {"assign": long_enough,
                                      "markov": looks_random(ratios, threshold)})


def spelled(found: Column) -> Column:
    """kind:start:end of spans, in order of start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans() -> Column:
    return F.concat("assign", "access", "hex", "markov")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``scan_secrets`` replaced by ``[secret]`` in the text."""
    merged = F.aggregate(F.array_sort(all_spans()), F.array().cast(
        "array<struct<start:bigint,end:bigint>>"), lambda a, s: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]),
            F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(
                F.element_at(a, -1)["start"].alias("start"),
                F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))))).otherwise(
            F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    # the text between the spans, in pieces that are joined once
    spans = F.col("_spans")
    part = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    before = F.transform(spans, lambda s, i: part(F.when(i == 0, _zero()).otherwise(
        F.element_at(spans, F.greatest(i, F.lit(1)))["end"]), s["start"]))
    rest = F.substring(F.col("text"), (F.element_at(spans, -1)["end"] + 1).cast("int"), F.char_length("text"))
    cutting = F.array_join(F.concat(before, F.array(rest)), "[secret]")
    n = F.size("assign") + F.size("access") + F.size("hex") + F.size("markov")
    return docs.withColumn("_spans", F.when(n > 0, merged)).withColumn(
        "text", F.when(n > 0, cutting).otherwise(F.col("text"))).drop("_spans")
