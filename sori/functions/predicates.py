"""Conditions on rows, as column expressions that reach the scan where the source can filter."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sori import constants as C
from sori.functions.times import local_time


def near_window(utc: Column, end: str, days: int) -> Column:
    """Coarse range over stored times: a day of slop on each side, as local days shift by hours. Pushed to the scan."""
    last = date.fromisoformat(end)
    return (utc >= F.lit((last - timedelta(days)).isoformat()).cast("timestamp_ntz")) & (utc < F.lit((last + timedelta(2)).isoformat()).cast("timestamp_ntz"))


def in_window(utc: Column, end: str, days: int) -> Column:
    """Exact cut after :func:`near_window`: the local day is one of the last ``days`` up to ``end``."""
    last = date.fromisoformat(end)
    return local_time(utc).cast("date").between(F.lit((last - timedelta(days - 1)).isoformat()).cast("date"), F.lit(end).cast("date"))


def active_version(source: Column, prompt: Column, model: Column, pipeline: Column, prompts: dict[str, str], active_model: str, active_pipeline: str) -> Column:
    """Whether the active labeller made a row: its source's prompt, the model and the pipeline, null nowhere equal."""
    wanted = F.lit(None).cast("string")
    for name, version in prompts.items():
        wanted = F.when(source == name, version).otherwise(wanted)
    return prompt.eqNullSafe(wanted) & model.eqNullSafe(F.lit(active_model)) & pipeline.eqNullSafe(F.lit(active_pipeline))


def of_sources(source: Column, names: list[str]) -> Column:
    """Whether a document is from one of the sources; from none if no source is named, and never if its source is null."""
    return F.coalesce(source.isin(*names), F.lit(False)) if names else F.lit(False)


def has_content(text: Column) -> Column:
    return text.isNotNull() & (F.trim(text) != "")


def after(time: Column, key: Column, cursor: tuple) -> Column:
    """Rows behind a cursor in the order of (time, key)."""
    at = F.lit(cursor[0]).cast("timestamp_ntz")
    return (time > at) | ((time == at) & (key > cursor[1]))


def in_month(time: Column, month: str) -> Column:
    """Half-open range of a month (yyyy-mm), so that it is pushed to the scan."""
    first = date.fromisoformat(f"{month}-01")
    following = (first + timedelta(32)).replace(day=1)
    return (time >= F.lit(first.isoformat()).cast("timestamp_ntz")) & (time < F.lit(following.isoformat()).cast("timestamp_ntz"))


def owned(rows: DataFrame, tenant: str, **keys: str) -> DataFrame:
    """Rows of a tenant with all given key values; a null key never fits."""
    condition = F.col("tenant") == tenant
    for name, value in keys.items():
        condition &= F.col(name) == value
    return rows.where(condition)


def corpus_row(source: Column, split: Column, text: Column, aspects: Column, sources: tuple[str, ...], splits: tuple[str, ...], length: tuple[int, int], leaked: tuple[str, ...]) -> Column:
    """Rows fit for an evaluation set: source and split, a length in range, no leaked beginning, at least one attribute."""
    leak = F.exists(F.array(*map(F.lit, leaked)), lambda p: F.contains(text, p)) if leaked else F.lit(False)
    return source.isin(*sources) & split.isin(*splits) & F.length(text).between(*length) & ~leak & (F.size(aspects) > 0)


def in_scope(aspect: Column) -> Column:
    """Attributes whose causes are diagnosed."""
    return aspect.isin(*C.SCOPE)


def of_slots(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Rows of the listed slots (product, aspect, channel, source); slots that repeat do no harm."""
    return rows.join(slots, ["product", "aspect", "channel", "source"], "left_semi")


def gates(inquiries: Column, action: Column) -> tuple[Column, Column]:
    """Whether a guideline (some inquiries as evidence) and a recommendation (the action asks for one) are made."""
    return F.coalesce(F.size(inquiries) > 0, F.lit(False)), F.coalesce(action == C.ACTIONS["recommend"], F.lit(False))
