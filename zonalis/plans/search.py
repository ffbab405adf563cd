"""Ranked search over area names and codes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.keys import ACCENTED, PLAIN, folded_name
from zonalis.runtime import shuffle_partitions

#: Abbreviations that also match the long form.
ALIASES = {"st": "saint", "ste": "sainte"}
SHOWN = 60


def tokens_of(text: str) -> list[str]:
    folded = text.lower().translate(str.maketrans(ACCENTED, PLAIN)).replace("œ", "oe").replace("æ", "ae")
    return re.sub("[^a-z0-9]", " ", folded).split()


def search(areas: DataFrame, text: str, shown: int = SHOWN) -> DataFrame:
    """The best of ``areas(code, name, population)`` for typed words or a code's first digits, with their rank
    and the number of further matches.

    Rank 0 is the whole name (or code), 1 a name that starts with the first word, 2 all words at word starts, 3
    any place; then by population and name. Only the shown rows are sorted as a whole (top-k per task).
    """
    if re.fullmatch(r"\d[\dab]*", text.strip().lower()):
        digits = text.strip().upper()
        found = areas.where(F.col("code").startswith(digits)).withColumn("rank", F.when(F.col("code") == digits, 0).otherwise(1))
    else:
        words = tokens_of(text)
        folded = F.col("__f")
        starts, anywhere = [], []
        for word in words:
            forms = [word, *([ALIASES[word]] if word in ALIASES else [])]
            at_start = folded.rlike("(^| )(" + "|".join(forms) + ")")
            starts.append(at_start)
            anywhere.append(at_start | folded.contains(word))
        every, all_starts = F.lit(True), F.lit(True)
        for s, a in zip(starts, anywhere):
            every, all_starts = every & a, all_starts & s
        forms = [words[0], *([ALIASES[words[0]]] if words and words[0] in ALIASES else [])] if words else [""]
        first = folded.rlike("^(" + "|".join(forms) + ")")
        rank = F.when(F.trim(folded) == " ".join(words), 0).when(first, 1).when(all_starts, 2).otherwise(3)
        found = areas.withColumn("__f", folded_name(F.col("name"))).where(every).withColumn("rank", rank).drop("__f")
    more = found.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
    top = found.orderBy("rank", F.col("population").desc(), "name", "code").limit(shown)
    return top.crossJoin(F.broadcast(more))


#: The code point after every token's and code's, which ends a range of prefixes.
AFTER = "\U0010ffff"


def token_table(areas: DataFrame) -> DataFrame:
    """``(token, kind, code, name, population)``: what search() can find a row of ``areas`` by.

    Every token of the folded name ('first' at the name's start, else 'start'), every later part of one ('inside') and
    the row's code ('code'). Sorted by token over ranges, so that a written table is read by the ranges asked for.
    """
    folded = folded_name(F.col("name"))
    words = F.split(folded, " ")
    parts = F.transform(words, lambda w, i: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda j: F.struct(
        F.substring(w, j, F.length(w)).alias("token"), F.when(j > 1, F.lit("inside")).when(i == 0, F.lit("first")).otherwise(F.lit("start")).alias("kind"))))
    items = F.concat(F.filter(F.flatten(F.coalesce(parts, F.array())), lambda t: t["token"] != ""), F.array(F.struct(F.col("code").alias("token"), F.lit("code").alias("kind"))))
    rows = areas.select("code", "name", "population", F.explode(F.array_distinct(items)).alias("t"))
    rows = rows.select("t.token", "t.kind", "code", "name", "population").where("token is not null")
    return rows.repartitionByRange(shuffle_partitions(areas.sparkSession), "token").sortWithinPartitions("token")


def write_token_table(areas: DataFrame, path: str) -> None:
    """token_table() as Parquet files of consecutive tokens."""
    token_table(areas).write.parquet(path)


def search_tokens(table: DataFrame, text: str, shown: int = SHOWN) -> DataFrame:
    """search() on a token_table(): the same rows from the ranges of tokens that start with a typed word."""
    row = ["code", "name", "population"]
    starting = lambda p: (F.col("token") >= p) & (F.col("token") < p + AFTER)
    if re.fullmatch(r"\d[\dab]*", text.strip().lower()):
        digits = text.strip().upper()
        found = table.where(starting(digits) & (F.col("kind") == "code")).select(*row, F.when(F.col("code") == digits, 0).otherwise(1).alias("rank"))
    else:
        words = tokens_of(text)
        if not words:
            # Every row has its code once.
            found = table.where("kind = 'code'").select(*row, F.when(F.trim(folded_name(F.col("name"))) == "", 0).when(F.col("name").isNull(), 2).otherwise(1).alias("rank"))
        else:
            found = None
            for i, word in enumerate(words):
                here = starting(word)
                if word in ALIASES:
                    here = here | (starting(ALIASES[word]) & (F.col("kind") != "inside"))
                hits = table.where(here & (F.col("kind") != "code")).groupBy(*row).agg(F.bool_or(F.col("kind") != "inside").alias(f"start{i}"), F.bool_or(F.col("kind") == "first").alias(f"first{i}"))
                found = hits if found is None else found.join(hits.drop("first0"), row)
            all_starts = F.lit(True)
            for i in range(len(words)):
                all_starts = all_starts & F.col(f"start{i}")
            whole = F.trim(folded_name(F.col("name"))) == " ".join(words)
            found = found.select(*row, F.when(whole, 0).when(F.col("first0"), 1).when(all_starts, 2).otherwise(3).alias("rank"))
    more = found.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
    top = found.orderBy("rank", F.col("population").desc(), "name", "code").limit(shown)
    return top.crossJoin(F.broadcast(more))
