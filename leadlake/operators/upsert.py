"""Writes as DataFrame transformations: every function returns the new table.

The caller decides where to write it; not writing it is a dry run. Targets are
unique on their key, and sources are reduced to one row per key first, so the
merge joins never multiply rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions.contacts import is_search_phone, search_phone
from leadlake.functions.tags import total
from leadlake.functions.text import blank, strip
from leadlake.operators.aggregates import contact_flags
from leadlake.operators.ranking import keep_last, top_per_key
from leadlake.schemas import CONTACT_KEY, TERRITORY_KEY

SEQ = "fill_score"
CODE = "credit_code"
CONTACT_TYPES = ("mobile", "landline", "email")
CONTACT_STATES = ("contacted", "blocked", "interested", "rejected")
EDITABLE = (
    "company_name", "legal_person", "status", "scale", "capital_wan", "capital_raw",
    "address", "website", "scope", "province", "city", "district", "street",
    "industry_l1", "industry_l2", "industry_l3",
)
FLAG_COLUMNS = (
    "has_mobile", "has_landline", "has_email", "has_contact", "mobile_count", "email_count",
)
#: Characters that an edited value or a note may have, and the business scope; longer ones are rejected.
LONGEST_VALUE, LONGEST_SCOPE = 500, 2000


def upsert_rows(target: DataFrame, source: DataFrame, keys=(CODE,), seq=SEQ, arrival=()) -> DataFrame:
    """Whole rows replace each other; the greater sequence value wins.

    On equal values the source wins over the target, and the last arrival wins
    inside the source.
    """
    keys = list(keys)
    marked = target.withColumn("__incoming", F.lit(0)).unionByName(
        source.withColumn("__incoming", F.lit(1)), allowMissingColumns=True
    )
    order = [F.desc_nulls_last(seq), F.desc("__incoming"), *[F.desc_nulls_last(a) for a in arrival]]
    return top_per_key(marked, keys, order, 1).drop("__incoming")


def patch_columns(
    target: DataFrame, patch: DataFrame, columns: Sequence[str], keys=(CODE,), seq: str | None = SEQ
) -> DataFrame:
    """Only the listed columns change, also to NULL; rows keep the rest.

    A patch older than the row (smaller sequence value) is ignored. The patch
    has one row per key.
    """
    keys, columns = list(keys), list(columns)
    changed = columns + ([seq] if seq and seq not in columns else [])
    new = patch.select(*keys, F.struct(*changed).alias("__new"))
    accepted = F.col("__new").isNotNull()
    if seq:
        accepted = accepted & (F.col(f"__new.{seq}") >= F.coalesce(F.col(seq), F.lit(0)))
    types = dict(target.dtypes)
    merged = target.join(new, keys, "left")
    return merged.select(
        *[
            F.when(accepted, F.col(f"__new.{c}").cast(types[c])).otherwise(F.col(c)).alias(c)
            if c in changed
            else F.col(c)
            for c in target.columns
        ]
    )


def fill_blanks(
    target: DataFrame, source: DataFrame, columns: Sequence[str], new_score, key=CODE, seq=SEQ
) -> DataFrame:
    """Blank cells take the source's value and raise the score by one each.

    Filled cells never change. Keys the target does not know are added with
    ``new_score`` (a number, or a source column). The source has one row per key.
    """
    columns = list(columns)
    types = dict(target.dtypes)
    score = F.lit(new_score) if isinstance(new_score, int) else F.col(f"s.{new_score}")
    joined = target.alias("t").join(source.alias("s"), F.col(f"t.{key}") == F.col(f"s.{key}"), "full")
    known = F.col(f"t.{key}").isNotNull()
    fills = {c: blank(F.col(f"t.{c}")) & ~blank(F.col(f"s.{c}")) for c in columns}
    filled = total([f.cast("int") for f in fills.values()])
    out = []
    for c in target.columns:
        if c == key:
            value = F.coalesce(F.col(f"t.{key}"), F.col(f"s.{key}"))
        elif c == seq:
            value = F.when(known, F.coalesce(F.col(f"t.{seq}"), F.lit(0)) + filled).otherwise(score)
        elif c in fills:
            value = F.when(fills[c], F.col(f"s.{c}").cast(types[c])).otherwise(F.col(f"t.{c}"))
        else:
            value = F.col(f"t.{c}")
        out.append(value.cast(types[c]).alias(c))
    return joined.select(*out)


def append_contacts(target: DataFrame, batch: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Contact points are unique on (company, type, value); the last one stays."""
    marked = target.withColumn("__incoming", F.lit(0)).unionByName(
        batch.withColumn("__incoming", F.lit(1)), allowMissingColumns=True
    )
    return keep_last(marked, CONTACT_KEY, ["__incoming", *arrival]).drop("__incoming")


def replace_slice(target: DataFrame, fresh: DataFrame, column: str, value: str) -> DataFrame:
    """Everything of one source goes, its new rows come."""
    kept = target.filter(~F.col(column).eqNullSafe(F.lit(value)))
    return kept.unionByName(fresh, allowMissingColumns=True)


def refresh_flags(companies: DataFrame, contacts: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Reach flags recomputed from the contacts of existing companies.

    With ``touched`` (company codes) only those change, also to zero when the
    last contact is gone; without it, companies that have contacts.
    """
    flags = contact_flags(contacts)
    if touched is not None:
        keys = touched.select(CODE).distinct()
        flags = keys.join(flags, CODE, "left").fillna(0, subset=list(FLAG_COLUMNS))
    current = companies.select(CODE, (F.coalesce(F.col(SEQ), F.lit(0)) + 1).alias(SEQ))
    return patch_columns(companies, flags.join(current, CODE), FLAG_COLUMNS)


def checked_edits(edits: DataFrame, longest: int = LONGEST_VALUE, longest_scope: int = LONGEST_SCOPE) -> DataFrame:
    """Edits with trimmed values; ``reject_reason`` is NULL for good ones. No value is cut."""
    value = strip(F.col("value"))
    most = F.when(F.col("field") == "scope", longest_scope).otherwise(longest)
    reason = F.when(~F.coalesce(F.col("field").isin(*EDITABLE), F.lit(False)), "field not editable").when(
        F.length(value) > most, "value too long"
    )
    return edits.withColumns({"value": value, "reject_reason": reason})


def edit_companies(companies: DataFrame, edits: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Apply the good ones of rows (credit_code, field, value), trimmed.

    The last edit of a field wins; each edited company gains one score point.
    """
    good = checked_edits(edits).filter(F.col("reject_reason").isNull())
    last = keep_last(good, [CODE, "field"], arrival)
    wide = last.groupBy(CODE).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__edits")
    )
    types = dict(companies.dtypes)
    out = []
    for c in companies.columns:
        new = F.try_element_at("__edits", F.lit(c))
        if c in EDITABLE:
            edited = F.map_contains_key("__edits", c)
            out.append(F.when(edited, new.try_cast(types[c])).otherwise(F.col(c)).alias(c))
        elif c == SEQ:
            bump = F.when(F.col("__edits").isNotNull(), 1).otherwise(0)
            out.append((F.coalesce(F.col(SEQ), F.lit(0)) + bump).cast(types[c]).alias(c))
        else:
            out.append(F.col(c))
    return companies.join(wide, CODE, "left").select(*out)


def checked_contacts(changes: DataFrame) -> DataFrame:
    """Normalise contact additions; ``reject_reason`` is NULL for good ones."""
    kind = F.lower(strip(F.coalesce(F.col("contact_type"), F.lit(""))))
    raw = strip(F.coalesce(F.col("contact_value"), F.lit("")))
    phone = search_phone(raw)
    value = (
        F.when(kind == "mobile", phone)
        .when(kind == "email", F.lower(raw))
        .otherwise(F.regexp_replace(raw, r"[\s\p{Z}]", ""))
    )
    reason = (
        F.when(~kind.isin(*CONTACT_TYPES), "unknown type")
        .when(raw == "", "empty value")
        .when((kind == "mobile") & ~is_search_phone(phone), "not a phone number")
        .when((kind == "email") & ~raw.contains("@"), "not an e-mail address")
    )
    return changes.select(
        *[c for c in changes.columns if c not in ("contact_type", "contact_value")],
        kind.alias("contact_type"), value.alias("contact_value"), reason.alias("reject_reason"),
    )


def add_contacts(companies: DataFrame, contacts: DataFrame, changes: DataFrame, arrival):
    """Manual additions: (contacts, companies with new flags, rejected changes)."""
    names = companies.select(CODE, "company_name", F.lit(True).alias("__known"))
    found = checked_contacts(changes).join(names, CODE, "left")
    reason = F.coalesce("reject_reason", F.when(F.col("__known").isNull(), "unknown company"))
    checked = found.withColumn("reject_reason", reason).drop("__known")
    known = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    merged = append_contacts(contacts, known.withColumn("source", F.lit("manual")), arrival)
    flagged = refresh_flags(companies, merged, known)
    return merged, flagged, checked.filter(F.col("reject_reason").isNotNull()).drop("company_name")


def delete_contacts(companies: DataFrame, contacts: DataFrame, deletions: DataFrame):
    """Remove contact points by key: (contacts, companies with new flags)."""
    keys = deletions.select(
        CODE,
        F.lower(strip(F.col("contact_type"))).alias("contact_type"),
        strip(F.col("contact_value")).alias("contact_value"),
    ).distinct()
    kept = contacts.join(keys, CONTACT_KEY, "left_anti")
    return kept, refresh_flags(companies, kept, keys)


def checked_status(changes: DataFrame, longest: int = LONGEST_VALUE) -> DataFrame:
    """State changes with ``reject_reason``, NULL for good ones. No note is cut."""
    note = F.coalesce(F.col("note"), F.lit(""))
    reason = F.when(~F.coalesce(F.col("status").isin(*CONTACT_STATES), F.lit(False)), "unknown state").when(
        F.length(note) > longest, "note too long"
    )
    return changes.withColumns({"note": note, "reject_reason": reason})


def latest_status(changes: DataFrame, arrival=("updated_at",)) -> DataFrame:
    """Current state per (company, user) of the changes that ``checked_status`` finds good."""
    valid = checked_status(changes).filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return keep_last(valid, [CODE, "user_id"], arrival)


def territory_rules(changes: DataFrame, arrival=("loaded_at",)) -> DataFrame:
    return keep_last(changes, TERRITORY_KEY, arrival)


def changed_cells(before: DataFrame, after: DataFrame, protected: Sequence[str], key=CODE) -> DataFrame:
    """Violations of 'enrichment never changes a filled cell': (key, field, before, after)."""
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("field"),
                    F.col(f"b.{c}").cast("string").alias("before"),
                    F.col(f"a.{c}").cast("string").alias("after"),
                )
                for c in protected
            ]
        )
    )
    joined = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"))
    rows = joined.select(F.col(f"b.{key}").alias(key), cells.alias("cell")).select(key, "cell.*")
    return rows.filter(
        ~blank(F.col("before")) & ~blank(F.col("after")) & (F.col("before") != F.col("after"))
    )
