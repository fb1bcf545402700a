"""Domain rules: ranges, allowed values and text patterns by column name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import as_list, as_text, col, is_numeric, is_text, no_rows, order_key, percent, present, profiled_fields


@dataclass(frozen=True)
class Rule:
    domain: str
    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = field(default=())
    pattern: str | None = None

    def violated(self, f) -> Column:
        """True for a violation, false otherwise, never null."""
        c = present(f)
        if self.kind == "numeric":
            v = c.cast("double") if is_numeric(f) else as_text(f).try_cast("double")
            bad = F.lit(False)
            if self.low is not None:
                bad = bad | (v < F.lit(float(self.low)))
            if self.high is not None:
                bad = bad | (v > F.lit(float(self.high)))
            return F.coalesce(bad, F.lit(False))
        if self.kind == "category":
            return ~F.coalesce(as_text(f).isin(list(self.allowed)), F.lit(False))
        return F.coalesce(~as_text(f).rlike(self.pattern), F.lit(False))

    def describe(self) -> str:
        if self.kind == "numeric":
            return f"[{self.low}, {self.high}]"
        return ", ".join(self.allowed) if self.kind == "category" else str(self.pattern)


# The rules of each domain.
DOMAIN_RULES = [
    Rule("healthcare", "age", "numeric", 0, 120),
    Rule("healthcare", "heart_rate", "numeric", 40, 200),
    Rule("healthcare", "temperature", "numeric", 35, 42),
    Rule("healthcare", "blood_pressure_systolic", "numeric", 70, 200),
    Rule("healthcare", "weight_kg", "numeric", 1, 500),
    Rule("healthcare", "glucose", "numeric", 50, 600),
    Rule("ecommerce", "price", "numeric", 0, None),
    Rule("ecommerce", "stock", "numeric", 0, None),
    Rule("ecommerce", "discount_percent", "numeric", 0, 100),
    Rule("ecommerce", "product_code", "text", pattern="^[A-Z0-9]{3,20}$"),
    Rule("ecommerce", "sku", "text", pattern="^[A-Z0-9-]{5,50}$"),
    Rule("hr", "age", "numeric", 18, 75),
    Rule("hr", "salary", "numeric", 500, 10000000),
    Rule("hr", "employee_id", "text", pattern="^[A-Z]{2}[0-9]{6}$"),
    Rule("hr", "department", "category",
         allowed=("IT", "HR", "Finance", "Sales", "Operations", "Marketing")),
    Rule("finance", "transaction_amount", "numeric", 0, None),
    Rule("finance", "interest_rate", "numeric", 0, 100),
    Rule("finance", "account_balance", "numeric", None, None),
    Rule("finance", "iban", "text", pattern="^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}$"),
    Rule("government", "age", "numeric", 0, 120),
    Rule("government", "population", "numeric", 1, None),
    Rule("government", "zip_code", "text", pattern="^[0-9]{5}$"),
    Rule("government", "tax_id", "text", pattern="^[0-9]{8}[A-Z]$"),
]


def domain_rules(*domains: str) -> list[Rule]:
    known = {r.domain for r in DOMAIN_RULES}
    unknown = set(domains) - known
    if unknown:
        raise ValueError(f"unknown domains {sorted(unknown)}; known: {sorted(known)}")
    return [r for r in DOMAIN_RULES if not domains or r.domain in domains]


def rules_from_config(config: dict) -> list[Rule]:
    """Rules from ``{domain: {"rules": {name: {type, min, max, allowed, pattern}}}}``."""
    return [
        Rule(domain, name, r.get("type", "numeric"), r.get("min"), r.get("max"),
             tuple(str(a) for a in r.get("allowed") or ()), r.get("pattern"))
        for domain, node in config.items()
        for name, r in node["rules"].items()
    ]


def _matches(rule: Rule, column: str, match: str) -> bool:
    rule_name, low = rule.name.lower(), column.lower()
    if match == "substring":
        return rule_name in low
    if match == "token":
        return f"_{rule_name}_" in f"_{low}_"
    raise ValueError("match must be 'substring' or 'token'")


def _pairs(df, rules, match, by=()):
    fields = profiled_fields(df, None, by)
    return [(r, f) for r in rules for f in fields if _matches(r, f.name, match)]


def check_rules(df: DataFrame, rules: list[Rule], match: str = "substring", by=()) -> DataFrame:
    """One row per (rule, column) with its violations; all rules share one scan."""
    by = as_list(by)
    pairs = _pairs(df, rules, match, by)
    if not pairs:
        return no_rows(df, by, (
            "domain string, rule string, column_name string, rule_type string, rule_detail string, "
            "rows bigint, violations bigint, violation_percent double"))
    counts = df.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(r.violated(f)).alias(f"__v{i}") for i, (r, f) in enumerate(pairs)],
    )
    rows = [
        F.struct(
            F.lit(r.domain).alias("domain"), F.lit(r.name).alias("rule"), F.lit(f.name).alias("column_name"),
            F.lit(r.kind).alias("rule_type"), F.lit(r.describe()).alias("rule_detail"), F.col("rows"),
            F.col(f"__v{i}").alias("violations"),
            percent(F.col(f"__v{i}"), F.col("rows")).alias("violation_percent"),
        )
        for i, (r, f) in enumerate(pairs)
    ]
    return counts.select(*[col(b) for b in by], F.inline(F.array(*rows)))


def rule_examples(df: DataFrame, rules: list[Rule], row_key, match: str = "substring", k: int = 10) -> DataFrame:
    """The first ``k`` violating rows per (rule, column)."""
    keys = as_list(row_key)
    pairs = _pairs(df, rules, match)
    found = F.filter(
        F.array(*[
            F.struct(F.lit(r.domain).alias("domain"), F.lit(r.name).alias("rule"),
                     F.lit(f.name).alias("column_name"), as_text(f).alias("value"),
                     r.violated(f).alias("bad"))
            for r, f in pairs
        ]),
        lambda x: x["bad"],
    )
    bad = df.select(*[col(c) for c in keys], F.inline(found)).drop("bad")
    window = Window.partitionBy("domain", "rule", "column_name").orderBy(order_key(keys))
    return bad.withColumn("n", F.row_number().over(window)).where(F.col("n") <= k)


def check_allowed(df: DataFrame, column: str, allowed: DataFrame, allowed_column: str | None = None) -> DataFrame:
    """Category rule against a table of allowed values of any size.

    Equal values are counted first, so the join meets each value once and a hot
    value is a single row. Null is a violation.
    """
    key = allowed_column or allowed.columns[0]
    counts = df.groupBy(col(column).alias("__v")).agg(F.count(F.lit(1)).alias("cnt"))
    known = allowed.select(col(key).alias("__a")).where(F.col("__a").isNotNull()).distinct()
    marked = counts.join(known, F.col("__v") == F.col("__a"), "left")
    return marked.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("__a").isNull(), F.col("cnt"))), F.lit(0)).alias("violations"),
    ).select(
        F.lit(column).alias("column_name"), "rows", "violations",
        percent("violations", "rows").alias("violation_percent"),
    )
