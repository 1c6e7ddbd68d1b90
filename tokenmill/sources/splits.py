"""Named splits of a dataset: which to read and where to write them."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names that stand for a validation split, in order of preference.
VALIDATION = ("validation", "val")

# A request is a list of wanted splits, each with its acceptable names. Corpus exports need every
# wanted split; fine-tuning exports take what there is and accept 'test' for validation.
CORPUS_REQUESTS = {
    "train": [("train",)],
    "val": [VALIDATION],
    "validation": [VALIDATION],
    "both": [("train",), VALIDATION],
}
SFT_REQUESTS = {"val": [VALIDATION], "both": [("train",), (*VALIDATION, "test")]}
SFT_OPTIONAL = ("both",)


def _resolve(
    requested: str, available: set[str], requests: dict, optional: tuple[str, ...] = ()
) -> list[str]:
    wanted = requests.get(requested.lower(), [(requested,)])
    found = [next((n for n in names if n in available), None) for names in wanted]
    present = [n for n in found if n is not None]
    enough = present if requested.lower() in optional else len(present) == len(wanted)
    if not enough:
        raise ValueError(f"split '{requested}' is not among {sorted(available)}")
    return present


def corpus_splits(requested: str, available: Iterable[str]) -> list[str]:
    return _resolve(requested, set(available), CORPUS_REQUESTS)


def sft_splits(requested: str, available: Iterable[str]) -> list[str]:
    return _resolve(requested, set(available), SFT_REQUESTS, SFT_OPTIONAL)


def split_path(base: str, split: str, several: bool) -> str:
    """'out.txt' for a single split; 'out_val.txt' or 'out_<split>.txt' beside others."""
    if not several:
        return base
    stem, extension = posixpath.splitext(base)
    return f"{stem}_{'val' if split in VALIDATION else split}{extension}"


def tagged_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """One table from one table per split, with a ``split`` column."""
    tagged = [df.withColumn("split", F.lit(name)) for name, df in parts.items()]
    whole = tagged[0]
    for part in tagged[1:]:
        whole = whole.unionByName(part)
    return whole


def write_splits(
    df: DataFrame,
    splits: list[str],
    base: str,
    save: Callable[[DataFrame, str], int],
    column: str = "split",
) -> dict[str, tuple[str, int]]:
    """Write each split to its own path; returns split -> (path, rows written).

    ``save`` writes a table to a path and returns its rows. Each write filters on the split column, which prunes folders of a partitioned table.
    """
    written = {}
    for split in splits:
        path = split_path(base, split, len(splits) > 1)
        written[split] = (path, save(df.where(F.col(column) == split).drop(column), path))
    return written
