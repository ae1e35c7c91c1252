"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Kinds with a base rule (email, ip, card, phone) stand once their check passes; the
weaker kinds (iban, ssn) need check and context together to reach ``KEEP``. All is
one projection of built-in functions: no row leaves its partition.

Places are code points, end exclusive, from the lengths of the pieces between
matches: time grows with the text and with the number of matches. Patterns are written
with possessive runs and a look-behind at the start of
a run, so that very long runs of letters or digits cost linear time; they match what
the plain forms match.

Defined cases: a null text counts as empty and has no spans; repeated rows are
scanned one by one; an empty table gives an empty table; extra columns stay, those
named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.store import materialize

KEEP = 0.6
AROUND = 40
#: matches whose places are summed up at once
BLOCK = 256
_IPV4 = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kind, pattern, a character class that any match holds, score, context words
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9,
     "mail|contact|write"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.7, "ip|host|server|address"),
    ("card", r"[0-9]++(?:[ -][0-9]++)*+", r"[0-9][0-9 -]{14}", 0.9, "card|visa|credit|pay"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|call|tel|fax|mobile"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
     "[A-Z]{2}[0-9]{2}", 0.65, "iban|account|bank|transfer"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", 0.4, "ssn|social security|tax id"),
)
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def luhn(text: Column) -> Column:
    """True where the digits of ``text`` pass the Luhn check."""
    digits = F.reverse(F.split(F.regexp_replace(text, "[^0-9]", ""), ""))
    values = F.transform(
        F.filter(digits, lambda c: c != ""),
        lambda c, i: (c.cast("int") * (1 + i % 2)) - F.when((i % 2 == 1) & (c.cast("int") > 4), 9).otherwise(0),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """True where an IBAN's remainder is 1: letters count as 10 to 35."""
    bare = F.regexp_replace(text, " ", "")
    moved = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    return (
        F.aggregate(
            F.filter(F.split(moved, ""), lambda c: c != ""),
            F.lit(0),
            lambda a, c: F.when(c < "A", a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97,
        )
        == 1
    )


def confirmed(kind: str, x: Column) -> Column:
    n = F.length(F.regexp_replace(x, "[^0-9]", ""))
    if kind == "ip":
        return x.rlike(rf"^{_IPV4}(?:\.{_IPV4}){{3}}$")
    if kind == "card":
        return n.between(16, 19) & luhn(x)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return mod97(x)
    return F.lit(True)


def _cut(text: Column, pattern: str, holds: str) -> tuple[Column, Column]:
    """Matches, and the pieces before, between and after them; null where there can be none."""
    may = text.rlike(holds)
    return F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.when(may, F.split(text, pattern, -1))


def _judged(m: str, g: str, kind: str, score: float, context: str) -> Column:
    """Piece, match and score (null where check or context fail) of each match of one kind.

    Context is what stands within ``AROUND`` characters, no further than the neighbouring
    matches of the kind: so it costs the length of the pieces, not of the text.
    """
    first = F.array(F.lit(""))
    parts = F.arrays_zip(
        F.col(g).alias("g"), F.col(m).alias("x"), F.concat(first, g).alias("pg"), F.concat(first, m).alias("px"),
        F.slice(g, F.lit(2), F.size(g)).alias("ng"), F.slice(m, F.lit(2), F.size(g)).alias("nx"),
    )

    def judge(p: Column) -> Column:
        left = F.right(F.concat_ws("", p["pg"], p["px"], p["g"]), F.lit(AROUND))
        right = F.left(F.concat_ws("", p["ng"], p["nx"]), F.lit(AROUND))
        bonus = F.when(F.concat_ws(" ", left, right).rlike(rf"(?i)\b(?:{context})"), 0.3).otherwise(0.0)
        total = F.least(F.lit(1.0), F.lit(score) + bonus)
        stands = p["x"].isNotNull() & confirmed(kind, p["x"])
        if kind not in BASE:
            stands = stands & (total >= KEEP)
        return F.struct(p["g"].alias("g"), p["x"].alias("x"), F.when(stands, total).alias("score"))

    return F.transform(parts, judge)


def _placed(j: str, kind: str) -> Column:
    """Spans of the matches that stand. Running places are taken block by block, so that
    an array of many spans is not copied for every span."""
    none = F.array().cast(SPAN)

    def step(a: Column, z: Column) -> Column:
        start = a["at"] + F.length(z["g"])
        end = start + F.coalesce(F.length(z["x"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), z["score"].alias("score"))
        return F.struct(end.alias("at"), F.when(z["score"].isNotNull(), F.concat(a["r"], F.array(span))).otherwise(a["r"]).alias("r"))

    def block(a: Column, k: Column) -> Column:
        done = F.aggregate(F.slice(j, k * BLOCK + 1, F.lit(BLOCK)), F.struct(a["at"].alias("at"), none.alias("r")), step)
        return F.aggregate(F.array(done), a, lambda b, d: F.struct(d["at"].alias("at"), F.concat(b["r"], F.array(d["r"])).alias("r")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("r"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(j) - 1) / BLOCK).cast("int"))
    spans = F.flatten(F.aggregate(blocks, start, block, lambda a: a["r"]))
    return F.when(F.exists(j, lambda z: z["score"].isNotNull()), spans).otherwise(none)


def with_spans(docs: DataFrame, text: str = "text", kinds=KINDS) -> DataFrame:
    """Add ``pii``: spans (kind, start, end, score), by kind as listed, then start."""
    t = F.coalesce(F.col(text), F.lit(""))
    cuts = {}
    for kind, pattern, holds, _, _ in kinds:
        cuts[f"__m_{kind}"], cuts[f"__g_{kind}"] = _cut(t, pattern, holds)
    out = docs.withColumns(cuts)
    out = out.withColumns({f"__j_{k}": _judged(f"__m_{k}", f"__g_{k}", k, score, context) for k, _, _, score, context in kinds})
    out = out.withColumns({f"__s_{k[0]}": _placed(f"__j_{k[0]}", k[0]) for k in kinds})
    out = out.withColumn("pii", F.concat(*[f"__s_{k[0]}" for k in kinds]))
    return out.drop(*cuts, *[f"__{x}_{k[0]}" for x in "js" for k in kinds])


def redact(docs: DataFrame, text: str = "text", changed: str = "__changed", kinds=KINDS) -> DataFrame:
    """Each kind's spans replaced by [KIND], one kind after the other on what is left by
    those before it; ``changed`` tells whether there were any. One pass over the pieces.

    Each kind reads the text that the one before has left, several times over: write the
    result before filtering on its text, or Catalyst copies all steps into the filter."""
    out = docs.withColumn(changed, F.lit(False))
    for kind, pattern, holds, score, context in kinds:
        m, g = _cut(F.col(text), pattern, holds)
        out = out.withColumns({"__m": m, "__g": g}).withColumn("__j", _judged("__m", "__g", kind, score, context))
        hit = F.coalesce(F.exists("__j", lambda z: z["score"].isNotNull()), F.lit(False))
        tagged = F.array_join(_tagged("__j", f"[{kind.upper()}]"), "")
        out = out.withColumns({text: F.when(hit, tagged).otherwise(F.col(text)), changed: F.col(changed) | hit})
    return out.drop("__m", "__g", "__j")


def _tagged(j: str, tag: str) -> Column:
    return F.transform(j, lambda z: F.concat_ws("", z["g"], F.when(z["score"].isNotNull(), F.lit(tag)).otherwise(z["x"])))


def listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_spans(docs)
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text.

    No row goes: null and empty texts, null ids and repeated rows stay as they are, and an
    empty table gives an empty table. Columns other than text and n_chars are not touched.
    The result is a written table, so that no later filter is pushed into the replacements.
    """
    clean = redact(docs)
    length = F.when(F.col("__changed"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return materialize(clean.withColumn("n_chars", length).select(*docs.columns), "pii-clean")
