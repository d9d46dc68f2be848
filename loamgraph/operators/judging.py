"""Verdicts of a language model on entity names; the client is given, none is built in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.text import normal_name, slug
from loamgraph.operators.entities import Caps
from loamgraph.operators.ranking import with_position

# The kinds a verdict may name, in the order in which they are looked for.
VERDICT_KINDS = ("person", "concept", "technology", "organization", "work", "place")
BATCH = 10


@dataclass(frozen=True)
class Verdict:
    input: str
    keep: bool
    canonical: str
    kind: str


def build_prompt(items: list[str]) -> str:
    """One line a name, to be answered by KEEP with name and kind, or DROP."""
    head = f"Judge whether each of the {len(items)} names below is a proper name. Write one line for each, in the same order: KEEP, the right spelling and one of {'/'.join(VERDICT_KINDS)}; or DROP alone."
    return "\n".join([head, *items])


def parse_verdicts(reply: str, items: list[str]) -> list[Verdict] | None:
    """The verdict of each item by the lines that begin with KEEP or DROP; null if there are fewer lines than items.

    Lines beyond are dropped. What follows the last repeated KEEP is the name; a kind at its end is taken off, without
    one it is a concept; an empty name is the item's own."""
    lines = [line for line in map(str.strip, reply.strip().splitlines()) if line[:4].upper() in ("KEEP", "DROP")]
    if len(lines) < len(items):
        return None
    verdicts = []
    for item, line in zip(items, lines, strict=False):
        if line[:4].upper() == "DROP":
            verdicts.append(Verdict(item, False, item, ""))
            continue
        rest = line[4:].strip().rpartition("KEEP ")[2].strip()
        kind = next((k for k in VERDICT_KINDS if rest.lower().endswith(k)), None)
        name = rest[: len(rest) - len(kind)].strip() or item if kind else rest
        verdicts.append(Verdict(item, True, name, kind or "concept"))
    return verdicts


def ask_verdicts(names: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """(input, keep, canonical, kind) of names (name, position), in batches of ten, each asked a second time if unclear."""

    def run(_: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        items = batch.sort_values("position")["name"].tolist()
        for _try in range(2):
            try:
                found = parse_verdicts(complete(build_prompt(items)), items)
            except Exception:
                found = None
            if found is not None:
                return pd.DataFrame([vars(v) for v in found])
        return pd.DataFrame({"input": pd.Series(dtype=str), "keep": pd.Series(dtype=bool), "canonical": pd.Series(dtype=str), "kind": pd.Series(dtype=str)})

    return names.withColumn("batch", F.floor(F.col("position") / BATCH)).groupBy("batch").applyInPandas(run, "input string, keep boolean, canonical string, kind string")


def adjudicate(entities: DataFrame, complete: Callable[[str], str], caps: Caps = Caps()) -> DataFrame:
    """Entities with the verdicts on the most mentioned ones applied.

    A dropped one is withheld and flagged; a kept one shown, its kind set, and flagged where the model calls it by
    another name. Nothing is merged. Entities without a verdict stay as they are."""
    first = entities.orderBy(F.desc("mentions"), "id").limit(caps.judged) if caps.judged is not None else entities
    asked = with_position(first.select((-F.col("mentions")).alias("m"), "id", "name"), ["m", "id"]).select("id", "name", "position")
    verdicts = ask_verdicts(asked.select("name", "position"), complete).dropDuplicates(["input"])
    given = asked.join(verdicts, asked["name"] == verdicts["input"]).select("id", "keep", "canonical", F.col("kind").alias("new_kind"))
    rejected = F.array(F.lit("endpoint_rejected"))
    suggested = F.coalesce(normal_name(F.col("canonical")), F.col("canonical"))
    differs = (slug(suggested) != slug(F.col("name"))) & (suggested != "")
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    kept_flags = F.array_remove(flags, "endpoint_rejected")
    new_flags = F.when(~F.col("keep"), F.array_union(flags, rejected)).when(differs, F.array_union(kept_flags, F.array(F.concat(F.lit("endpoint_disagrees:"), suggested)))).otherwise(kept_flags)
    judged = entities.join(given, "id", "left")
    seen = F.col("keep").isNotNull()
    return judged.withColumns({"flags": F.when(seen, new_flags).otherwise(F.col("flags")), "withheld": F.when(seen, ~F.col("keep")).otherwise(F.col("withheld")), "kind": F.when(F.col("keep") & (F.col("new_kind") != ""), F.col("new_kind")).otherwise(F.col("kind"))}).select(entities.columns)
