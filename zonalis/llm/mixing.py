"""Mixing sources to target weights: repetition rates per source and hash-seeded copies.

A document is emitted floor(rate) times, and once more with a probability that is exactly the fraction. Documents differ
in length by orders of magnitude, so independent draws would leave a source of few documents far from its target. The
draws of a source are therefore one systematic draw: its documents stand by length, those of one length by the hash of
their id, and from an offset that the seed and the source give, each stretch of 1 / fraction documents has one copy.
Every document's chance is the fraction whatever its length, and a source's words are off by its longest document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.operators.ranking import distributed_row_number
from zonalis.runtime import broadcast_if_small, cut

#: Words ``[^\x20\x09-\x0D]+`` as Spark's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(key: Column, seed: str = SEED) -> Column:
    """52 bits of an MD5 of the seed and the key's text, as a number."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the key's text and the seed alone."""
    return draw(key, seed).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, size)``.

    Sources by code point, NULL last, weigh ``weights`` in turn and split ``share`` of all sizes; a target stops
    at ``most`` times its source's size and the excess goes to the others by weight until none is above. Every
    round fixes the sources above their limit at once and solves the level of the rest from two sums, so the
    driver sees a few numbers however many sources there are.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = distributed_row_number(per, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    table = cut(ranked.select("source", "source_size", weight.cast("bigint").alias("weight")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    limit = most * F.col("source_size")
    level, fixed = None, -1
    while True:
        full = F.lit(False) if level is None else limit <= F.col("weight") * F.lit(level)
        row = table.agg(F.count_if(full), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if row[0] == fixed or not row[2]:
            break
        fixed = row[0]
        level = (share * total - (row[1] or 0)) / row[2]
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(float(level or 0.0)))
    return table.select("source", "source_size", target.alias("target"))


#: Tables of up to so many rows are sent to every task; larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000


def drawn(units: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """``(source, size, draw)``: the distinct ``units(source, size, draw)`` that get a copy beyond floor(rate).

    Units are numbered by (source, size falling, draw) over ranges, so a hot source is many tasks' work; number i is
    drawn where i x fraction + offset passes a whole number.
    """
    rate = F.col("target") / F.col("source_size")
    offset = uniform(F.concat(F.lit("source:"), F.coalesce(F.col("s").cast("string"), F.lit("null"))), seed)
    rates = targets.where("source_size > 0").select(F.col("source").alias("s"), (rate - F.floor(rate)).alias("fraction")).withColumn("offset", offset).where("fraction > 0")
    same = F.col("source").eqNullSafe(F.col("s"))
    rows = units.join(broadcast_if_small(rates.select("s"), BROADCAST_SOURCES), same, "left_semi")
    numbered = cut(distributed_row_number(rows, [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("draw")], "at"))
    first = numbered.groupBy(F.col("source").alias("s")).agg(F.min("at").alias("first"))
    rates = cut(rates.join(first.withColumnRenamed("s", "s1"), F.col("s").eqNullSafe(F.col("s1"))).drop("s1"))
    i = F.col("at") - F.col("first") + 1
    passed = lambda i: F.floor(i * F.col("fraction") + F.col("offset"))
    return numbered.join(broadcast_if_small(rates, BROADCAST_SOURCES), same).where(passed(i) > passed(i - 1)).select("source", "size", "draw")


def repetition_rates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """Every column of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (replaced where present).

    ``copies`` = floor(rate), and one more for the rows of drawn(); rate = target / source_size. The draw takes the id,
    so reruns agree, and rows of one source that repeat an id and a length share its draw; rows with a NULL id draw by
    their text. NULL texts have size 0; NULL sources are a source of their own. A source without words has rate 0 and
    stays at one copy of each of its (empty) rows: there is nothing to mix. An empty table gives no rows.
    """
    new = ["size", "source_size", "target", "copies"]
    t = F.col(f"`{text}`")
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(t, F.lit("")).cast("binary"))))
    rows = docs.drop(*new).withColumn("size", n_words(t)).withColumn("__draw", draw(key, seed))
    slim = cut(rows.select(F.col(f"`{source}`").alias("source"), "size", F.col("__draw").alias("draw")))
    targets = cut(source_targets(slim.select("source", "size"), **how))
    named = targets.withColumnRenamed("source", "__s")
    extra = cut(drawn(slim.distinct(), targets, seed).select(F.col("source").alias("__of"), F.col("size").alias("__size"), F.col("draw").alias("__at"), F.lit(1).alias("__more")))
    joined = rows.join(broadcast_if_small(named, BROADCAST_SOURCES), F.col(f"`{source}`").eqNullSafe(F.col("__s"))).drop("__s")
    same = (F.col("__draw") == F.col("__at")) & (F.col("size") == F.col("__size")) & F.col(f"`{source}`").eqNullSafe(F.col("__of"))
    joined = joined.join(broadcast_if_small(extra, BROADCAST_SOURCES), same, "left")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")) + F.coalesce("__more", F.lit(0))).otherwise(F.lit(1))
    return joined.withColumn("copies", copies.cast("bigint")).drop("__draw", "__of", "__size", "__at", "__more")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, with the columns of ``docs`` whatever their names."""
    names = {"__id": id_col, "__text": text, "__source_of": source}
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], F.struct("*").alias("__cells"))
    rated = repetition_rates(slim, *names, **how).where("copies > 0")
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return rated.withColumn("__copy", copy).select(*[F.col(f"__cells.`{c}`") for c in docs.columns])


ORACLE = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), per as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3)::int + 1]::bigint as weight from per
), steps as (
  select *, 2.0::double * source_size / weight as ratio from weighed
), sums as (
  select *, coalesce(sum(2 * source_size) over (order by ratio, source rows between unbounded preceding and 1 preceding), 0) as fixed,
    sum(weight) over (order by ratio, source rows between current row and unbounded following) as rest,
    (select 1.5::double * sum(source_size) from per) as budget from steps
), levels as (
  select *, (budget - fixed::double) / rest::double as level from sums
), found as (
  select level from levels where ratio > level order by ratio, source limit 1
), targets as (
  select source, source_size, least(2.0::double * source_size, weight * coalesce((select level from found), 1e300)) as target from weighed
), drawn as (
  select doc_id, source, size, ('0x' || substr(md5('mix-1:' || doc_id::varchar), 1, 13))::bigint as draw from sized
), numbered as (
  select *, dense_rank() over (partition by source order by size desc, draw) as i from drawn
), rates as (
  select *, case when source_size > 0 then target / source_size - floor(target / source_size) else 0.0::double end as fraction,
    ('0x' || substr(md5('mix-1:source:' || coalesce(source, 'null')), 1, 13))::bigint::double / 4503599627370496.0::double as off from targets
)
select d.doc_id, d.size, t.source_size, t.target,
  d.size * (case when t.source_size > 0 then floor(t.target / t.source_size)::bigint + case when floor(i * fraction + off) > floor((i - 1) * fraction + off) then 1 else 0 end else 1 end)::bigint as taken
from numbered d join rates t on d.source is not distinct from t.source
"""


def brute_copies(rows: list[tuple], seed: str = SEED) -> list[int]:
    """Copies of each (id, text, source) row by plain loops; for tests."""
    import hashlib

    digest = lambda x: int(hashlib.md5(f"{seed}:{x}".encode()).hexdigest()[:13], 16)
    sizes = [len((t or "").split()) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in names}
    share, full = 1.5 * sum(sizes), set()
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        level = (share - 2 * sum(total[s] for s in full)) / rest if rest else 0.0
        more = {s for s in names if s not in full and 2 * total[s] <= weight[s] * level}
        if not more:
            break
        full |= more
    out = [0] * len(rows)
    for s in names:
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        rate = (2.0 if s in full else min(2.0 * total[s], weight[s] * level) / total[s]) if total[s] else 1.0
        whole = int(rate)
        ids = {i: str(rows[i][0]) if rows[i][0] is not None else "null:" + hashlib.md5((rows[i][1] or "").encode()).hexdigest() for i in mine}
        place = {i: (-sizes[i], digest(ids[i])) for i in mine}
        offset = digest(f"source:{'null' if s is None else s}") / (1 << 52)
        hit = set()
        for at, unit in enumerate(sorted(set(place.values())), 1):
            if int(at * (rate - whole) + offset) > int((at - 1) * (rate - whole) + offset):
                hit.add(unit)
        for i in mine:
            out[i] = whole + (place[i] in hit)
    return out
