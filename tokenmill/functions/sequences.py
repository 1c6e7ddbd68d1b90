"""Expressions over token-id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_INDEX = -100  # fixed value: label of positions that carry no loss


def _int(value: int) -> Column:
    return F.lit(value).cast("int")


def truncate_pair(prompt: Column, response: Column, max_len: int) -> tuple[Column, Column]:
    """Trim an overlong pair to ``max_len`` ids from the left, the prompt before the response."""
    overflow = F.greatest(F.size(prompt) + F.size(response) - _int(max_len), _int(0))
    off_prompt = F.least(F.size(prompt), overflow)
    off_response = overflow - off_prompt
    return (
        F.slice(prompt, off_prompt + 1, F.size(prompt) - off_prompt),
        F.slice(response, off_response + 1, F.size(response) - off_response),
    )


def next_token_labels(ids: Column, prompt_len: Column) -> Column:
    """Label t is id t+1 where that id belongs to the response; elsewhere IGNORE_INDEX."""
    masked = F.greatest(prompt_len, _int(1))
    return F.concat(
        F.array_repeat(_int(IGNORE_INDEX), masked - 1),
        F.slice(ids, masked + 1, F.size(ids) - masked),
        F.array(_int(IGNORE_INDEX)),
    )


def supervised_count(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORE_INDEX))


def pad_to(ids: Column, block: int, fill: int) -> Column:
    """Exactly ``block`` ids: cut on the right or filled on the right."""
    return F.concat(
        F.slice(ids, 1, block),
        F.array_repeat(_int(fill), F.greatest(_int(block) - F.size(ids), _int(0))),
    )


def last_ids(ids: Column, count: int) -> Column:
    """The trailing ``count`` ids, or all of a shorter array."""
    first = F.greatest(F.size(ids) - _int(count), _int(0))
    return F.slice(ids, first + 1, _int(count))


def digest(ids: Column) -> Column:
    """md5 of the comma-joined elements, a scalar stand-in for comparing arrays."""
    return F.md5(F.concat_ws(",", ids.cast("array<string>")))
