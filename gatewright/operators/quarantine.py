"""One-pass evaluation of rules: an anchor table is scanned once, however many rules it has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.enrich import ENRICH, Tables, schema_counts
from ..plans.rules import Fields, Rule
from ..schemas import OWNERS, QUARANTINE


def owner_of(category: Column) -> Column:
    """The owner of a rule category; null for one that has none."""
    return F.coalesce(*[F.when(category == c, F.lit(o)) for c, o in OWNERS.items()])


def require_owner(category: str) -> str:
    """The owner of a gate category; an unknown category is an error."""
    if category not in OWNERS:
        raise ValueError(f"no owner is assigned to rule category {category!r}")
    return OWNERS[category]


def enriched(tables: Tables, anchor: str, rules: Iterable[Rule], run_date: str) -> DataFrame:
    """The anchor table with the context that these rules need, and no other."""
    needs = {n for r in rules for n in r.needs}
    if anchor == "schema_counts" and anchor not in tables:
        return schema_counts(tables["file_manifest"], tables.get("schemas"))
    return ENRICH[anchor](tables[anchor], tables, needs, run_date)


def snapshot_of(df: DataFrame) -> Column:
    """All columns as one map of texts; a null field is an empty text."""
    pairs = [x for c in df.columns for x in (F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))]
    return F.create_map(*pairs)


def _lineage(anchor: str) -> tuple[Column, Column]:
    if anchor == "file_manifest":
        return F.col("file_name"), F.lit(None).cast("bigint")
    if anchor == "schema_counts":
        return F.lit(""), F.lit(None).cast("bigint")
    return F.col("source_file"), F.col("source_row").cast("bigint")


def violations(tables: Tables, rules: Iterable[Rule], run_date: str, snapshots: bool = True, details: bool = True) -> DataFrame:
    """Every failing row of every rule: one scan and one explode for each anchor table.

    A row is exploded to the numbers of the rules, those that hold null, and what is null goes. So
    each predicate is evaluated once a row, in generated code; no filter is put below the explode,
    which is an outer one, to evaluate them again; and names, details and snapshots are made of the
    rows that are left.
    """
    rules = list(rules)
    parts = []
    for anchor in dict.fromkeys(r.anchor for r in rules):
        own = [r for r in rules if r.anchor == anchor]
        df, fields = enriched(tables, anchor, own, run_date), Fields()
        numbers = F.array(*[F.when(r.predicate(fields), F.lit(i)) for i, r in enumerate(own)])
        hits = df.select("*", F.explode_outer(numbers).alias("_v")).where(F.col("_v").isNotNull())
        source_file, source_row = _lineage(anchor)
        schema = F.col("schema") if "schema" in df.columns else F.lit(None).cast("string")
        kept = [source_file.alias("source_file"), source_row.alias("source_row"), schema.alias("schema")]
        if snapshots:
            kept.insert(2, snapshot_of(df).alias("snapshot"))
        named = hits.select(*kept, _named(own).alias("_r"), _detail(own, fields, details).alias("detail"))
        parts.append(named.select(*[c for c in named.columns if c not in ("_r", "detail")], "_r.*", "detail"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _named(rules: list[Rule]) -> Column:
    """Name, category, level and column of the rule with the number ``_v``."""
    text = lambda value, name: F.lit(value).cast("string").alias(name)
    each = [F.struct(text(r.name, "rule_name"), text(r.category, "rule_category"), text(r.level, "level"), text(r.column, "column_name")) for r in rules]
    return F.get(F.array(*each), F.col("_v"))


def _detail(rules: list[Rule], fields: Fields, wanted: bool) -> Column:
    out = F.lit(None).cast("string")
    for i, r in enumerate(rules if wanted else []):
        out = F.when(F.col("_v") == i, r.detail(fields)).otherwise(out)
    return out


def quarantine(tables: Tables, rules: Iterable[Rule], run_id: str, run_date: str) -> DataFrame:
    """The canonical quarantine table of one run. Its ids are hashes of what they name."""
    v = violations(tables, rules, run_date)
    made_of = [F.lit(run_id), F.col("rule_name"), F.coalesce("source_file", F.lit("")), F.coalesce(F.col("source_row").cast("string"), F.lit("")), F.coalesce("column_name", F.lit("")), F.coalesce("schema", F.lit(""))]
    whole = v.withColumns({"quarantine_id": F.sha2(F.concat_ws("\u0001", *made_of), 256), "owner_name": owner_of(F.col("rule_category")), "run_id": F.lit(run_id), "detected_at": F.to_timestamp(F.lit(run_date))})
    return whole.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in QUARANTINE.fields])


def rule_rows(tables: Tables, rule: Rule, run_date: str) -> DataFrame:
    """The failing rows of one rule, without snapshots."""
    v = violations(tables, [rule], run_date, snapshots=False)
    return v.select("rule_name", "rule_category", owner_of(F.col("rule_category")).alias("owner_name"), "schema", "source_file", "source_row", "column_name", "detail")


def counts_by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_name").agg(F.count("*").alias("n")).orderBy("rule_name")


def missing_lineage(found: DataFrame) -> DataFrame:
    """How many violations there are, and how many lack a file or a row."""
    lacking = F.coalesce(F.col("source_file"), F.lit("")).eqNullSafe("") | F.col("source_row").isNull()
    return found.agg(F.count("*").alias("violations"), F.count_if(lacking).alias("missing_lineage"))
