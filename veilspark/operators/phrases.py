"""The dictionary of custom phrases: equivalence and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import fold_away, trimmed, widened


def equivalent(a: Column, b: Column) -> Column:
    return widened(fold_away(a)) == widened(fold_away(b))


def _outcome(status: str, phrases: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), phrases.alias("phrases"))


def edited(phrases: Column, raw: Column, index: Column | None = None) -> Column:
    """(status, phrases) after adding ``raw`` or, at a 0-based ``index`` that isn't null, replacing a phrase.

    Blank text and indexes outside the list change nothing; an equivalent of another phrase is a duplicate; the same text again
    changes nothing.
    """
    new = trimmed(raw)
    index = F.lit(None).cast("int") if index is None else index
    same = F.exists(phrases, lambda p: equivalent(p, new))
    other = F.exists(F.transform(phrases, lambda p, i: (i != index) & equivalent(p, new)), lambda x: x)
    inside = (index >= 0) & (index < F.size(phrases))
    replaced = F.transform(phrases, lambda p, i: F.when(i == index, new).otherwise(p))
    edit = (
        F.when(~inside, _outcome("unchanged", phrases))
        .when(other, _outcome("duplicate", phrases))
        .when(F.get(phrases, index) == new, _outcome("unchanged", phrases))
        .otherwise(_outcome("changed", replaced))
    )
    add = F.when(same, _outcome("duplicate", phrases)).otherwise(_outcome("changed", F.array_append(phrases, new)))
    return F.when(new == "", _outcome("unchanged", phrases)).when(index.isNotNull(), edit).otherwise(add)


def removed(phrases: Column, index: Column) -> Column:
    """``phrases`` without the one at a 0-based index, if there is one; a null index removes none."""
    return F.filter(phrases, lambda p, i: ~i.eqNullSafe(index))


def persisted(dictionaries: DataFrame, edits: DataFrame, owner: str) -> DataFrame:
    """``dictionaries`` (owner, phrases) after ``edits`` (owner, outcome as of ``edited``): only outcomes that changed something are stored.

    ``notified`` is true for those, and for no other. An owner has one edit at most; edits of unknown owners are ignored.
    """
    new = edits.where("outcome.status = 'changed'").select(owner, F.col("outcome.phrases").alias("_new"))
    both = dictionaries.join(new, owner, "left")
    return both.select(owner, F.coalesce("_new", "phrases").alias("phrases"), F.col("_new").isNotNull().alias("notified"))
