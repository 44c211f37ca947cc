"""Secret scans: base patterns, and weak parts of a credential that count only beside the other parts.

Base kinds are ``assign``, ``access`` and ``hex``. Weak candidates are short access identifiers (``weak_access``), short
assigned values (``weak_secret``) and ``endpoint`` urls. Every part has a role: identifier (access, weak_access),
secret (assign, hex, weak_secret) or endpoint. A weak candidate is reported when parts of both other roles lie within
``reach`` code points of it in the same text: an interval join of each weak part's scope with the nearest parts of
the other roles before and after it, done by running maxima and minima, so that no pair is ever made.

Positions: the gaps between the matches of a pattern and the matches themselves, summed up in order. One row per match
leaves the scan; texts never do. Rows of one document meet in one task, as the text itself does.

Defined results: a null text is empty; repeated rows are scanned alike, each for itself; spans are in code points, end
exclusive, by start and then kind in the order above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: The patterns of the contract. The hex and access patterns carry their least length, since they match
#: whole runs; the assign pattern has to take short values too, which hide what follows them.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{8,}"
HEX = r"[0-9a-f]{16,}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""
SHORT_ACCESS, SHORT_SECRET, SECRET = 18, 6, 12
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
ROLES = {"access": "id", "weak_access": "id", "assign": "secret", "hex": "secret", "weak_secret": "secret", "endpoint": "endpoint"}


def matches(text: str, pattern: str, name: str, group: int = 0) -> Column:
    """The matches of a pattern as array of (name, order, gap before, length, length of a group)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.split(text, pattern).alias("gap"), whole.alias("whole"), inner.alias("inner"))
    rows = F.transform(
        F.filter(zipped, lambda z: z["whole"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(name).alias("pattern"), i.alias("at"), F.length(z["gap"]).alias("gap"),
            F.length(z["whole"]).alias("size"), F.length(z["inner"]).alias("inner"),
        ),
    )
    return F.when(F.col(text).rlike(pattern), rows)


def secret_parts(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """One row per match, and one without a match for each document: row id, ``carry``, kind, start, end."""
    scanned = docs.select(
        *[F.col(f"`{c}`") for c in carry], F.monotonically_increasing_id().alias("__row"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"),
    )
    found = [matches("__text", ASSIGN, "assign", 1), matches("__text", ACCESS, "access"), matches("__text", HEX, "hex"), matches("__text", ENDPOINT, "endpoint")]
    empty = F.array().cast("array<struct<pattern:string,at:int,gap:int,size:int,inner:int>>")
    every = F.concat(*[F.coalesce(x, empty) for x in found])
    kept = [F.col(f"`{c}`") for c in carry]
    rows = scanned.select(*kept, "__row", F.explode_outer(every).alias("m")).select(*kept, "__row", "m.*")
    in_order = Window.partitionBy("__row", "pattern").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartition("__row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(in_order).cast("long"))
    kind = (
        F.when(F.col("pattern") == "assign", F.when(F.col("inner") >= SECRET, "assign").when(F.col("inner") >= SHORT_SECRET, "weak_secret"))
        .when(F.col("pattern") == "access", F.when(F.col("size") >= SHORT_ACCESS, "access").otherwise("weak_access"))
        .otherwise(F.col("pattern"))
    )
    return rows.select(*kept, "__row", kind.alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")


def link_parts(parts: DataFrame, reach: int = 300) -> DataFrame:
    """``parts`` with ``reported``: base kinds always, weak ones when both other roles lie within ``reach``."""
    def role(name: str) -> Column:
        return F.col("kind").isin([k for k, r in ROLES.items() if r == name])

    order = [F.col("start"), F.col("kind")]
    before = Window.partitionBy("__row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("__row").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    names = ("id", "secret", "endpoint")
    parts = parts.withColumns({f"__last_{r}": F.max(F.when(role(r), F.col("end"))).over(before) for r in names})
    parts = parts.withColumns({f"__next_{r}": F.min(F.when(role(r), F.col("start"))).over(after) for r in names})

    def near(name: str) -> Column:
        back = F.coalesce(F.col("start") - F.col(f"__last_{name}") <= reach, F.lit(False))
        return back | F.coalesce(F.col(f"__next_{name}") - F.col("end") <= reach, F.lit(False))

    weak = (
        (F.col("kind").eqNullSafe("weak_access") & near("secret") & near("endpoint"))
        | (F.col("kind").eqNullSafe("weak_secret") & near("id") & near("endpoint"))
        | (F.col("kind").eqNullSafe("endpoint") & near("id") & near("secret"))
    )
    reported = F.coalesce(F.col("kind").isin("assign", "access", "hex"), F.lit(False)) | weak
    return parts.withColumn("reported", reported).drop(*[f"__{w}_{r}" for w in ("last", "next") for r in names])


def scan_secrets(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), reach: int = 300) -> DataFrame:
    """One row per document: ``carry`` and ``spans``, its reported parts as array of (start, kind number, kind, end)."""
    parts = link_parts(secret_parts(docs, text, list(carry)), reach)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", number.alias("number"), "kind", "end")
    spans = F.sort_array(F.collect_list(F.when(F.col("reported"), span))).alias("spans")
    grouped = parts.groupBy("__row").agg(*[F.first(f"`{c}`").alias(c) for c in carry], spans)
    return grouped.drop("__row")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op3_secret_scan(spark, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    base = F.filter("spans", lambda s: s.number <= 3)
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )
