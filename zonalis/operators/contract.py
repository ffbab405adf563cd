"""Data-contract checks; each returns violations as rows (Q1-Q12)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions import geometry as G
from zonalis.functions.keys import CODE

ROWS = "check string, level string, detail string, n bigint"
#: Kinds of map layers.
LAYER_KINDS = ("choropleth", "polygon", "point", "line")
TYPES = ("numeric", "ordinal", "categorical")


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], ROWS)


def table_shape(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Missing key, no rows, no value columns (Q1)."""
    faults = []
    if key not in df.columns:
        faults.append(("no_key", "error", key, 1))
    if df.limit(1).count() == 0:
        faults.append(("no_rows", "error", "", 1))
    if not values:
        faults.append(("no_values", "error", "", 1))
    return df.sparkSession.createDataFrame(faults, ROWS)


def key_faults(df: DataFrame, key: str = "code") -> DataFrame:
    """Malformed, wrongly long and repeated keys with five samples each (Q2)."""
    k = F.col(key).cast("string")
    counted = df.groupBy(k.alias("k")).agg(F.count("*").alias("c"))
    kind = F.when(~F.coalesce(F.col("k").rlike(CODE), F.lit(False)), F.when(F.length("k") != 5, "key_length").otherwise("malformed_key")).when(F.col("c") > 1, "duplicate_key")
    bad = counted.withColumn("check", kind).where("check is not null")
    ranked = bad.groupBy("check").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    first = bad.withColumn("r", F.row_number().over(W.partitionBy("check").orderBy("k"))).where("r <= 5")
    samples = first.groupBy("check").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("detail"))
    return ranked.join(samples, "check").select("check", F.lit("error").alias("level"), "detail", "n")


def declaration_faults(columns: Sequence[str], fields: DataFrame, key: str = "code") -> DataFrame:
    """Columns without declaration and the reverse, bad types, numerics without unit (Q3). ``fields(field, type, unit)``."""
    spark = fields.sparkSession
    have = spark.createDataFrame([(c,) for c in columns if c != key], "field string")
    one = lambda df, check, level: df.select(F.lit(check).alias("check"), F.lit(level).alias("level"), F.col("field").alias("detail"), F.lit(1).cast("bigint").alias("n"))
    out = one(have.join(fields, "field", "left_anti"), "undeclared", "error").unionByName(one(fields.join(have, "field", "left_anti"), "missing", "error"))
    out = out.unionByName(one(fields.where(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))), "bad_type", "error"))
    return out.unionByName(one(fields.where("type = 'numeric' and coalesce(trim(unit), '') = ''"), "no_unit", "warning"))


def unparsable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of declared numerics that aren't numbers (Q4); one pass over the table."""
    if not columns:
        return _empty(df)
    row = df.agg(*[F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") & F.col(c).cast("string").try_cast("double").isNull()).alias(c) for c in columns])
    items = F.array(*[F.struct(F.lit("unparsable").alias("check"), F.lit("error").alias("level"), F.lit(c).alias("detail"), F.col(c).alias("n")) for c in columns])
    return row.select(F.explode(items).alias("v")).select("v.*").where("n > 0")


def join_rate(diagnostics: DataFrame, least: float = 0.95) -> DataFrame:
    """A join rate below the least (Q5), from join_diagnostics()."""
    return diagnostics.where(F.coalesce(F.col("rate"), F.lit(0.0)) < least).select(F.lit("join_rate").alias("check"), F.lit("error").alias("level"), F.format_string("%.4f", F.coalesce("rate", F.lit(0.0))).alias("detail"), F.col("unmatched").alias("n"))


def name_collisions(fields: DataFrame) -> DataFrame:
    """Fields that several tables declare (Q6). ``fields(source, field)``."""
    many = fields.groupBy("field").agg(F.count_distinct("source").alias("n")).where("n > 1")
    return many.select(F.lit("collision").alias("check"), F.lit("error").alias("level"), F.col("field").alias("detail"), "n")


def feature_faults(df: DataFrame, allowed: Sequence[str], box: tuple[float, float, float, float], geom_type: str = "geom_type", rings: str = "rings") -> DataFrame:
    """Wrong types, shape faults and features outside the box (Q7)."""
    b = G.bounds(F.col(rings))
    outside = ~G.boxes_overlap(b, *box)
    names = F.concat(G.shape_faults(F.col(rings)), F.array_compact(F.array(F.when(~F.col(geom_type).isin(*allowed), F.lit("geometry_type")), F.when(outside, F.lit("outside")))))
    return df.select(F.explode(names).alias("check")).groupBy("check").agg(F.count("*").alias("n")).select("check", F.lit("error").alias("level"), F.lit("").alias("detail"), "n")


def layer_faults(layers: DataFrame) -> DataFrame:
    """Required keys, colours against breaks, rising stops, hex colours, ordinals without stops, bare ranks (Q8).

    ``layers(layer, type, breaks array<double>, colors array<string>, stops array<double>)``, and, where they exist,
    ``label, group, kind`` (one of LAYER_KINDS), ``ranked, band, note``.
    """
    rising = F.forall(F.zip_with(F.slice("stops", 1, F.greatest(F.size("stops") - 1, F.lit(0))), F.slice("stops", 2, F.greatest(F.size("stops") - 1, F.lit(0))), lambda a, b: a < b), lambda ok: ok)
    checks = [
        ("no_layer", F.col("layer").isNull()),
        ("color_count", F.col("breaks").isNotNull() & (F.size("colors") != F.size("breaks") + 1)),
        ("stops_not_rising", F.col("stops").isNotNull() & ~rising),
        ("not_hex", F.exists("colors", lambda c: ~c.rlike("^#[0-9A-Fa-f]{6}$"))),
        ("ordinal_without_stops", (F.col("type") == "ordinal") & F.col("stops").isNull()),
    ]
    checks += [(f"no_{c}", F.col(c).isNull()) for c in ("label", "group", "kind") if c in layers.columns]
    if "kind" in layers.columns:
        checks.append(("bad_kind", ~F.col("kind").isin(*LAYER_KINDS)))
    if "ranked" in layers.columns:
        checks.append(("bare_rank", F.col("ranked") & F.col("band").isNull() & F.col("note").isNull()))
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))
    return layers.select(F.explode(names).alias("check"), F.lit("error").alias("level"), F.coalesce("layer", F.lit("")).alias("detail"), F.lit(1).cast("bigint").alias("n"))


def gate(violations: DataFrame, what: str) -> None:
    """Raises with five samples unless the frame is empty (Q9)."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def long_names(columns: Sequence[str], most: int = 10) -> list[str]:
    """Column names that a shapefile would cut (Q10)."""
    return [c for c in columns if len(c) > most]


def reference_profile(df: DataFrame, reference: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Known places: ours beside the published value and the difference (Q11)."""
    joined = df.join(reference, key)
    return joined.select(key, *[c for pair in columns.items() for c in pair], *[(F.col(a) - F.col(b)).alias(f"{a}_difference") for a, b in columns.items()])


def reconciliation(df: DataFrame, parts: Sequence[str], total: str, most: float = 0.01) -> DataFrame:
    """Rows whose parts miss their total by more than a share (Q12); reported, not fatal."""
    whole: Column = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
    off = F.abs(whole - F.col(total)) / F.abs(F.col(total))
    return df.withColumn("parts", whole).withColumn("off", off).where(F.col("off") > most)
