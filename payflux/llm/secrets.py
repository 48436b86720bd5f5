"""Secret scan with linking of credentials that come in parts.

Base kinds are reported wherever they stand: `assign` (a value given to a word like password),
`access` (an access key id) and `hex` (24 or more hex digits). Weak kinds mean little alone:
`id` (a user or client id given a value), `key` (32 or more characters of base64) and `endpoint`
(an address with a scheme). A weak one is reported only if a part that complements it stands at
most REACH characters away in the same scope: a secret (assign, hex, key) for an id or an
endpoint; an identifier (access, id) or an endpoint for a key. A scope is a run of lines without
a blank one. A key that overlaps a base span is that span and not counted again.

The co-occurrence is an interval join: parts are dealt out by text, scope and the cells of
length REACH that they touch, weak ones also by those within reach. It is a semi-join, so the
rows don't multiply, and only texts with a weak candidate take part. Linking depends on the text
alone: each text is linked once, however often it occurs.

Null texts are empty and give no spans. Offsets are code points, ends exclusive. Equal rows give
equal results. Added columns whose names the input has get underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from payflux.functions.names import unused
from payflux.functions.numbering import materialised
from payflux.llm.common import let

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
VALUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"(?i:(password|passwd|secret|token|api_?key)){VALUE}([A-Za-z0-9+/_.=-]+)"
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "id": rf"(?i:user_?name|user|login|client_?id|account_?id){VALUE}[A-Za-z0-9@._-]{{3,}}",
    "key": r"[A-Za-z0-9+/_-]{32,}={0,2}",
    "endpoint": r"""(?i:https?|ftp|s3|postgres|postgresql|mysql|mongodb|redis|amqp|jdbc:[a-z0-9]+)://[^\x20\x09-\x0D"'<>]+""",
}
#: What a text must have for the kind to be looked for.
HINTS = {"assign": rf"(?i:password|passwd|secret|token|api_?key){VALUE}[A-Za-z0-9+/_.=-]{{6}}", "endpoint": "://"}
LEAST_VALUE = 6
REACH = 200
BLANK_LINE = r"\n[\x20\t]*\n"
ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "id": "identifier", "endpoint": "endpoint"}
SPAN = "array<struct<start:int,kind:int,end:int>>"
_CHUNK = 512


def running(xs: Column) -> Column:
    """Sums of an array up to each entry; in chunks, as an array that is appended to is copied."""

    def fold(of: Column, start: Column) -> Column:
        return F.aggregate(
            of,
            F.struct(start.cast("int").alias("sum"), F.array().cast("array<int>").alias("out")),
            lambda a, x: F.struct((a["sum"] + x).cast("int").alias("sum"), F.array_append(a["out"], (a["sum"] + x).cast("int")).alias("out")),
        )["out"]

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _CHUNK).cast("int")), lambda k: F.slice(xs, k * _CHUNK + 1, F.lit(_CHUNK)))
    ends = fold(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)), F.lit(0))
    starts = F.concat(F.array(F.lit(0)), ends)
    return F.flatten(F.transform(chunks, lambda c, k: fold(c, F.get(starts, k))))


def spans(text: Column, pattern: str, kind: int, hint: str | None = None) -> Column:
    """Leftmost matches that don't overlap. What split() leaves between them gives the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.transform(found, F.length)
    ends = running(F.zip_with(lengths, F.slice(gaps, 1, F.size(found)), lambda n, g: n + F.length(g)))
    out = F.zip_with(ends, lengths, lambda e, n: F.struct((e - n).alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
    if pattern == ASSIGN:
        value = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.length)
        out = F.filter(F.zip_with(out, value, lambda s, n: F.when(n >= LEAST_VALUE, s)), lambda s: s.isNotNull())
    return F.when(text.rlike(hint or pattern), out).otherwise(F.array()).cast(SPAN)


def candidates(text: Column) -> dict[str, Column]:
    """Arrays of spans: base ones, and (where both a weak one and a complement may be) weak ones and blank lines."""
    each = {k: spans(text, p, i, HINTS.get(k)) for i, (k, p) in enumerate(PATTERNS.items())}
    return {
        "base": F.array_sort(F.concat(each["assign"], each["access"], each["hex"])),
        "weak": F.concat(each["id"], each["key"], each["endpoint"]),
        "blank": spans(text, BLANK_LINE, -1),
    }


def linked(rows: DataFrame) -> DataFrame:
    """rows (digest, base, weak, blank) -> digest, more: the weak spans that have a complement, for each text that has any."""
    rows = rows.where(F.size("weak") > 0).dropDuplicates(["digest"])
    rows = rows.withColumn(
        "weak", F.filter("weak", lambda w: ~((w["kind"] == 4) & F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))))
    )
    parts = rows.select("digest", F.inline(F.concat("base", "weak", "blank")))
    in_text = Window.partitionBy("digest").orderBy("start", "kind", "end")
    parts = parts.withColumn("scope", F.sum((F.col("kind") == -1).cast("int")).over(in_text)).where("kind >= 0")
    names = F.array(*(F.lit(ROLES[k]) for k in KINDS))
    parts = parts.withColumn("role", F.element_at(names, F.col("kind") + 1))
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / REACH), F.floor(high / REACH)))
    w = parts.where("kind >= 3").withColumn("cell", cells(F.greatest(F.col("start") - REACH, F.lit(0)), F.col("end") + REACH)).alias("w")
    p = parts.withColumn("cell", cells(F.col("start"), F.col("end"))).alias("p")
    near = (F.col("p.start") < F.col("w.end") + REACH) & (F.col("w.start") < F.col("p.end") + REACH)
    other = (F.col("w.role") == "secret") != (F.col("p.role") == "secret")
    same = [F.col(f"w.{c}") == F.col(f"p.{c}") for c in ("digest", "scope", "cell")]
    hits = w.join(p, same[0] & same[1] & same[2] & near & other, "left_semi")
    return hits.groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).cast(SPAN).alias("more"))


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns keep) with base and findings: arrays of (start, kind, end), kind as a number in KINDS.

    Each text is searched once: what is found is kept by a checkpoint, with the columns kept.
    """
    keep = df.columns if keep is None else keep
    # columns of the input have names of our own on the way
    inner = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*(F.col(c).alias(i) for c, i in zip(keep, inner, strict=True)), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(*inner, "text", *(c.alias(n) for n, c in candidates(F.col("text")).items()))
    rows = materialised(rows.select(*inner, "base", "weak", "blank", F.when(F.size("weak") > 0, F.sha2("text", 256)).alias("digest")))
    # a text without weak candidates links to nothing, and stays where it is
    alone, some = rows.where(F.col("digest").isNull()), rows.where(F.col("digest").isNotNull())
    more = linked(some.select("digest", "base", "weak", "blank")).withColumnRenamed("digest", "its_digest")
    some = some.join(more, some["digest"] == more["its_digest"], "left")
    findings = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    out = some.select(*inner, "base", findings.alias("findings")).unionByName(alone.select(*inner, "base", F.col("base").alias("findings")))
    return out.toDF(*keep, *unused(keep, "base", "findings"))


def listed(found: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def masked(text: Column, found: Column, mark: str) -> Column:
    """text with mark in place of each finding, overlapping ones as one.

    In chunks of findings, each with its own piece of the text: else each finding would count characters from the start.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _CHUNK).cast("int")), lambda k: F.slice(found, k * _CHUNK + 1, F.lit(_CHUNK)))

    def reaches(cs: Column) -> Column:
        """Where the chunks up to each one end, from 0."""
        tops = F.transform(cs, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
        return F.aggregate(tops, F.array(F.lit(0)), lambda a, top: F.array_append(a, F.greatest(F.element_at(a, -1), top)))

    def piece_of(c: Column, begin: Column, end: Column) -> Column:
        return let(F.substring(text, begin + 1, end - begin), lambda piece: F.aggregate(
            c,
            F.struct(begin.alias("to"), F.array().cast("array<string>").alias("out")),
            lambda a, s: F.when(
                s["start"] >= a["to"],
                F.struct(s["end"].alias("to"), F.concat(a["out"], F.array(F.substring(piece, a["to"] - begin + 1, s["start"] - a["to"]), F.lit(mark))).alias("out")),
            ).otherwise(F.struct(F.greatest(a["to"], s["end"]).alias("to"), a["out"].alias("out"))),
            lambda a: F.concat_ws("", a["out"]),
        ))

    def whole(given: Column) -> Column:
        pieces = F.transform(given["chunks"], lambda c, k: piece_of(c, F.get(given["at"], k), F.get(given["at"], k + 1)))
        return F.concat(F.concat_ws("", pieces), F.substring(text, F.element_at(given["at"], -1) + 1, F.length(text)))

    return let(chunks, lambda cs: let(F.struct(cs.alias("chunks"), reaches(cs).alias("at")), whole))


def redacted(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with each finding in the text replaced by mark; overlapping findings by one."""
    rows = scan(df, text)
    found = rows.columns[-1]
    return rows.withColumn(text, F.when(F.size(found) > 0, masked(F.col(text), F.col(found), mark)).otherwise(F.col(text))).select(*df.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their base spans and those that linking adds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scan(docs, keep=["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"),
    )


def _sql_spans(kind: int, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    least = f" where length(v) >= {LEAST_VALUE}" if pattern == ASSIGN else ""
    return f"""
    select doc_id, {kind} as kind, e - length(m) as s, e from (
      select doc_id, m, v, sum(length(g) + length(m)) over (partition by doc_id order by i) as e from (
        select doc_id, unnest(regexp_extract_all(t, '{quoted}', 0)) as m, unnest(regexp_extract_all(t, '{quoted}', {2 if least else 0})) as v,
               unnest(regexp_split_to_array(t, '{quoted}')) as g, unnest(range(len(regexp_split_to_array(t, '{quoted}')))) as i
        from texts) where m is not null){least}"""


OP1_SQL = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(_sql_spans(i, PATTERNS[k]) for i, k in enumerate(KINDS))}),
blank as ({_sql_spans(-1, BLANK_LINE)}),
base as (select * from found where kind < 3),
weak as (select * from found w where kind >= 3 and not (kind = 4 and exists (
  select 1 from base b where b.doc_id = w.doc_id and b.s < w.e and w.s < b.e))),
parts as (select *, kind in (0, 2, 4) as secret from (select * from base union all select * from weak)),
more as (select * from parts w where kind >= 3 and exists (
  select 1 from parts p where p.doc_id = w.doc_id and p.secret <> w.secret and p.s < w.e + {REACH} and w.s < p.e + {REACH}
  and not exists (select 1 from blank x where x.doc_id = w.doc_id and x.s >= least(p.s, w.s) and x.s < greatest(p.s, w.s)))),
named as (select *, (['{"', '".join(KINDS)}'])[kind + 1] || ':' || s::bigint || ':' || e::bigint as label from (
  select doc_id, kind, s, e from base union all select doc_id, kind, s, e from more))
select t.doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
  sha256(coalesce(string_agg(label, ',' order by s, kind, e) filter (kind < 3), '')) as base_sha256,
  coalesce(string_agg(label, ',' order by s, kind, e), '') as spans
from texts t left join named n on t.doc_id = n.doc_id group by t.doc_id
"""
