"""Secret scans with rules and with character Markov models.

Everything here is DataFrame functions; no row ever leaves the JVM.

Rules find the base spans.  Beyond those, every long run of token characters
is scored by two first-order Markov models over characters, one of random
strings and one of ordinary identifiers: the mean log-likelihood ratio of its
character pairs decides.  Both models are counted from labelled samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from narrata.llm.scratch import cut

# The rules, in the order that breaks ties.
ASSIGN_KEY = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ASSIGN = ASSIGN_KEY + r"""\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Weight of a character's own probability, in samples.
BACKOFF = 20.0
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def find(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost non-overlapping matches in code points.

    The gaps between matches and the matches themselves, alternating, give the
    offsets by their lengths.  Matches whose ``group`` has fewer than ``least``
    characters are dropped after they have been consumed.
    """
    empty = F.array().cast(SPAN)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def walk(z: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.element_at(z["gaps"], i))
            stop = start + F.length(F.element_at(z["hits"], i))
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), F.element_at(z["values"], i).alias("value"))
            return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return F.aggregate(F.sequence(F.lit(1), F.size(z["hits"])), F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"]

    # Bound once: a lambda would split the text again at every step.
    split = F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits"), values.alias("values"))
    walked = F.element_at(F.transform(F.array(split), walk), 1)
    return F.when(text.rlike(pattern), F.filter(walked, lambda s: F.length(s["value"]) >= least)).otherwise(empty)


def pairs(value: Column) -> Column:
    """Numbers of a string's character pairs; characters outside ALPHABET have number 0."""
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1)))
    width = len(ALPHABET) + 1
    return F.when(F.length(value) >= 2, F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: code(i) * width + code(i + 1))).otherwise(F.array().cast("array<int>"))


def train(samples: DataFrame) -> DataFrame:
    """Log-likelihood ratio per character pair from (value string, is_random boolean).

    A transition's probability is smoothed by that of the second character,
    ``BACKOFF`` times, and this by add-one; so characters that a label hardly
    has are unlikely anywhere in it, and without any sample its model is
    uniform.  At most ``(len(ALPHABET) + 1) ** 2`` rows.
    """
    width = len(ALPHABET) + 1
    counted = samples.select("is_random", F.explode(pairs(F.col("value"))).alias("pair")).groupBy("pair").agg(
        F.count(F.when(F.col("is_random"), 1)).alias("random"), F.count(F.when(~F.col("is_random"), 1)).alias("ordinary")
    )
    every = samples.sparkSession.range(width * width).select(F.col("id").cast("int").alias("pair"))
    filled = every.join(counted, "pair", "left").fillna(0)
    filled = filled.withColumns({"first": F.floor(F.col("pair") / width), "second": F.col("pair") % width})

    def chance(label: str) -> Column:
        of = lambda key: F.sum(label).over(Window.partitionBy(*key))
        alone = (of(["second"]) + 1.0) / (of([F.lit(0)]) + width)
        return (F.col(label) + BACKOFF * alone) / (of(["first"]) + BACKOFF)

    return filled.select("pair", (F.log(chance("random")) - F.log(chance("ordinary"))).alias("ratio"))


def corpus_samples(docs: DataFrame, found: Column, key: str, text: str, most: int) -> DataFrame:
    """Labelled samples: values of base spans, and words of letters and underscores.

    Both are taken from ``most`` texts at most, those whose keys have the
    smallest hashes: with base spans for the one, any for the other.
    """
    base = docs.select(key, text, found.alias("base"))
    random = _some(base.filter(F.size("base") > 0), key, most).select(F.explode("base.value").alias("value"), F.lit(True).alias("is_random"))
    words = _some(docs.filter(F.col(text).isNotNull()), key, most)
    words = words.select(F.explode(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z_/-]{4,}"), F.lit(0))).alias("value"), F.lit(False).alias("is_random"))
    return random.unionByName(words)


def _some(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows at most: those whose keys' hashes are under a bound, found from the keys' hashes alone."""
    place = F.xxhash64(F.col(key))
    bound = rows.select(place.alias("p")).orderBy("p").limit(most).agg(F.max("p")).first()[0]
    return rows.filter(place <= (0 if bound is None else bound))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: DataFrame | None = None, threshold: float = 0.5, most: int = 2000) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256, spans and found to every row.

    ``samples`` (value, is_random) trains the models; without it they are
    taken from ``most`` texts of the corpus by the base rules.  A run with a
    mean log-likelihood ratio of ``threshold`` or more that overlaps no base
    span becomes a ``markov`` span.  ``found`` holds all spans with their
    values.

    Edge cases: a null text counts as empty; empty texts have no spans and the
    checksum of the empty string; spans of equal start go by kind; a null key
    and repeated rows are rows like others; an empty table gives an empty one
    (models are then uniform).  Finding the spans of one text takes time with
    the square of their number in it.  Other columns pass through; columns
    named as this operator's own are replaced.
    """
    own = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in own])
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(find(whole, ASSIGN, 0, 2, 8), find(whole, ACCESS, 1), find(whole, HEX, 2)))
    model = train(corpus_samples(docs, base, key, text, most) if samples is None else samples)
    # The model: 4,761 numbers, whatever the size of the data.
    ratios = ",".join(repr(r["ratio"]) for r in cut(model, "secret-model").orderBy("pair").collect())
    table = F.split(F.lit(ratios), ",").cast("array<double>")
    out = docs.withColumn("__base", base).withColumn("__runs", find(whole, CANDIDATE, 3))
    total = lambda v: F.aggregate(pairs(v), F.lit(0.0), lambda acc, p: acc + F.element_at(table, p + 1))
    apart = lambda s: ~F.exists("__base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    more = F.filter("__runs", lambda s: apart(s) & (total(s["value"]) >= threshold * (F.length(s["value"]) - 1)))
    out = out.withColumn("found", F.array_sort(F.concat("__base", more)))
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        *docs.columns,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(said(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"),
        "found",
    )
