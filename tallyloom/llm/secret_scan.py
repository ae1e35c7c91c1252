"""Secret scans judged by corpus-wide ownership.

Patterns propose candidates in whole texts. Each candidate is known by the 128-bit hash of
its secret part; over the whole corpus the distinct repositories and owners of every hash
are counted. A string that several owners hold is a widely copied example (documentation,
test fixtures); one that a single owner holds and that looks drawn at random (letters,
digits, many different characters, no placeholder word) is a live-looking credential.

Kinds with a base rule (assign, access, hex) are always spans; the verdict is told beside
them. The weaker kinds (a vendor's prefix, a long string of mixed characters) become spans only
where their candidate is judged live, and only outside the spans before them.

Only candidates are shuffled (hash, repository, owner: some 60 bytes each), never texts.
Counts are taken in three steps, (hash, owner, repository), (hash, owner), (hash), so that a
hash in a third of all documents is added up beforehand everywhere; verdicts come back by a
join that broadcasts hot hashes with a bound. Documents without a candidate skip all that.

Defined cases: a null text counts as empty and has no spans; very long texts are scanned
whole; null repositories are one repository and null owners one owner; rows with a null or a
repeated id are scanned one by one; equal candidates of one text are spans of their own; an
empty table gives an empty table; extra columns stay out of the way: only ``keep`` returns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tallyloom.llm.hot import lookup
from tallyloom.llm.store import materialize

#: owners from which on a string counts as widely copied, distinct characters of a live-looking one
WIDE, VARIED = 3, 10
#: Kinds, their patterns, and the words of which a text holds one if it has a match
#: (None: no such word). Kinds of BASE are spans by themselves.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, ("passw", "secret", "token", "api")),
    ("access", r"AKIA[A-Z0-9]+", ("akia",)),
    ("hex", r"[0-9a-f]{32,}+", None),
    ("vendor", r"(?:gh[opsu]_|xox[abp]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}+", ("gh", "xox", "sk_live", "aiza")),
    ("mixed", r"[A-Za-z0-9+_-]{24,}+={0,2}", None),
)
#: what a mixed string holds: both cases, and digits in several places, unlike a title in a link
MIXED = ("[a-z]", "[A-Z]", "[0-9][^0-9]+[0-9][^0-9]+[0-9]")
BASE = ("assign", "access", "hex")
#: Parts of strings that stand in for a secret
PLACEHOLDERS = ("example", "changeme", "your", "xxxx", "placeholder", "dummy", "sample", "12345678", "abcdef")
CANDIDATE = "struct<kind:string,start:int,end:int,secret:binary,live:boolean>"


def looks_live(secret: str, varied: int = VARIED) -> bool:
    """Letters and digits, many different characters, nothing that stands in for a secret."""
    low = secret.lower()
    has = any("0" <= c <= "9" for c in secret) and any("a" <= c <= "z" for c in low)
    return has and len(set(secret)) >= varied and not any(p in low for p in PLACEHOLDERS)


def _stands(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m.group(2)) >= 8
    if kind == "access":
        return m.end() - m.start() >= 16
    return kind != "mixed" or all(re.search(p, m.group()) for p in MIXED)


class Scanner:
    """Candidates of one text, in order of place, then of kind as listed."""

    def __init__(self) -> None:
        #: letters of ``assign`` stand in either case, ASCII alone
        self.kinds = [(k, re.compile(p, re.A | (re.I if k == "assign" else 0)), words) for k, p, words in KINDS]

    def scan(self, text: str) -> list[dict]:
        low = text.lower()
        found: list[tuple[int, int, dict]] = []
        for order, (kind, pattern, words) in enumerate(self.kinds):
            if words and not any(w in low for w in words):
                continue
            before = sorted((f["start"], f["end"]) for _, _, f in found) if kind not in BASE else []
            at = 0
            for m in pattern.finditer(text):
                if not _stands(kind, m):
                    continue
                while at < len(before) and before[at][1] <= m.start():
                    at += 1
                if at < len(before) and before[at][0] < m.end():
                    continue  # inside a stronger kind's span
                secret = m.group(2) if kind == "assign" else m.group()
                digest = hashlib.blake2b(secret.encode(), digest_size=16).digest()
                row = {"kind": kind, "start": m.start(), "end": m.end(), "secret": digest, "live": looks_live(secret)}
                found.append((m.start(), order, row))
        return [f for _, _, f in sorted(found, key=lambda f: f[:2])]


def candidates(docs: DataFrame, text: str, keep: dict[str, Column]) -> DataFrame:
    """``keep`` and ``found``: the candidates of each row, in order."""
    cols = docs.select(F.col(text).cast("string").alias("_text"), *[c.alias(n) for n, c in keep.items()])
    schema = cols.drop("_text").schema.add("found", StructType.fromDDL(f"found array<{CANDIDATE}>")["found"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, kind = Scanner(), to_arrow_type(schema["found"].dataType)
        for b in batches:
            found = [scanner.scan(t.as_py() or "") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, kind)], names=[*b.schema.names[1:], "found"])

    return cols.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """(secret, repository, owner) rows -> secret, uses, n_repositories, n_owners."""
    by_repository = found.groupBy("secret", "owner", "repository").agg(F.count("*").alias("uses"))
    by_owner = by_repository.groupBy("secret", "owner").agg(F.count("*").alias("n"), F.sum("uses").alias("uses"))
    return by_owner.groupBy("secret").agg(F.sum("uses").alias("uses"), F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan_secrets(docs: DataFrame, repository: Column, owner: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), wide: int = WIDE) -> DataFrame:
    """One row per input row: ``keep`` and ``secrets``, an array of (kind, start, end,
    n_repositories, n_owners, verdict) by start, then kind. Verdicts: example, live, unclear."""
    marks = {"_row": F.monotonically_increasing_id(), "repository": repository.cast("string"), "owner": owner.cast("string")}
    rows = candidates(docs, text, {**{c: F.col(c) for c in keep}, **marks})
    rows = materialize(rows, "secret-candidates")
    each = rows.filter(F.size("found") > 0).select("_row", "repository", "owner", F.posexplode("found").alias("place", "c"))
    each = each.select("_row", "repository", "owner", "place", "c.*")
    known = materialize(ownership(each), "secret-owners")
    judged = lookup(each.drop("repository", "owner"), known, ["secret"])
    verdict = F.when(F.col("n_owners") >= wide, "example").when(F.col("live") & (F.col("n_owners") == 1), "live").otherwise("unclear")
    judged = judged.withColumn("verdict", verdict).filter(F.col("kind").isin(*BASE) | (F.col("verdict") == "live"))
    span = F.struct("place", F.struct("kind", "start", "end", "n_repositories", "n_owners", "verdict").alias("s"))
    spans = judged.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = rows.filter(F.size("found") > 0).select(*keep, "_row").join(spans, "_row", "left")
    spans_type = spans.schema["spans"].dataType.elementType["s"].dataType.simpleString()
    none = F.array().cast(f"array<{spans_type}>")
    out = out.select(*keep, F.coalesce(F.transform("spans", lambda s: s["s"]), none).alias("secrets"))
    return out.unionByName(rows.filter(F.size("found") == 0).select(*keep, none.alias("secrets")))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a repository, its source the owner."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    found = scan_secrets(docs, F.col("doc_id"), F.col("source"))

    def count(field: str, value: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s[field] == value)).cast("long")

    return found.select(
        "doc_id", *[count("kind", k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.filter("secrets", lambda s: s["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
        count("verdict", "live").alias("n_live"), count("verdict", "example").alias("n_examples"),
    )


def _found(kind: str, order: int, pattern: str, secret: str, stands: str) -> str:
    """Matches of one kind with their places, from the lengths of the pieces between them."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, '{kind}' AS kind, {order} AS o, i, m[i] AS x, {secret} AS secret,
    list_sum(list_transform(g[1:i], lambda z: length(z)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0)::BIGINT AS s
  FROM (SELECT doc_id, source, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d), range(1, 1000000) r(i)
  WHERE i <= len(m) AND ({stands})"""


_EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_ASSIGN_SQL = ASSIGN.replace("password|passwd|secret|token|api_?key", _EITHER)
_GROUP_2 = f"regexp_extract(m[i], '{_ASSIGN_SQL.replace(chr(39), chr(39) * 2)}', 2)"
_FREE = "NOT EXISTS (FROM {} z WHERE z.doc_id = c.doc_id AND z.s < c.s + length(c.x) AND c.s < z.s + length(z.x))"
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), base AS (
  {_found("assign", 0, _ASSIGN_SQL, _GROUP_2, f"length({_GROUP_2}) >= 8")}
  UNION ALL {_found("access", 1, "AKIA[A-Z0-9]+", "m[i]", "length(m[i]) >= 16")}
  UNION ALL {_found("hex", 2, "[0-9a-f]{32,}", "m[i]", "true")}
), vendor AS (
  SELECT * FROM ({_found("vendor", 3, KINDS[3][1].replace("}+", "}"), "m[i]", "true")}) c WHERE {_FREE.format("base")}
), mixed AS (
  SELECT * FROM ({_found("mixed", 4, KINDS[4][1].replace("}+", "}"), "m[i]", " AND ".join(f"regexp_matches(m[i], '{p}')" for p in MIXED))}) c
  WHERE {_FREE.format("(FROM base UNION ALL FROM vendor)")}
), c AS (
  FROM base UNION ALL FROM vendor UNION ALL FROM mixed
), own AS (
  SELECT secret, count(DISTINCT coalesce('+' || source, '-')) AS n_owners FROM c GROUP BY secret
), j AS (
  SELECT c.*, CASE WHEN n_owners >= {WIDE} THEN 'example'
    WHEN n_owners = 1 AND len(list_distinct(string_split(secret, ''))) >= {VARIED} AND regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[A-Za-z]')
      AND NOT regexp_matches(lower(secret), '{"|".join(PLACEHOLDERS)}') THEN 'live' ELSE 'unclear' END AS verdict,
    kind || ':' || s || ':' || (s + length(x)) AS told
  FROM c JOIN own USING (secret)
)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(told, ',' ORDER BY s, o) FILTER (o < 3), '')) AS base_sha256,
  coalesce(string_agg(told, ',' ORDER BY s, o) FILTER (o < 3 OR verdict = 'live'), '') AS spans,
  count(*) FILTER (verdict = 'live' AND (o < 3 OR verdict = 'live')) AS n_live, count(*) FILTER (verdict = 'example' AND o < 3) AS n_examples
FROM d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id
"""
