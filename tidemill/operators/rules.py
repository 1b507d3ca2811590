"""Rules over rows, and what happens to rows that break them.

A rule is a boolean column with a name; a null counts as broken unless the column says
otherwise. The first rule broken, in order, is the one reported. A policy maps kinds of
failure to Fail, Skip or DeadLetter; without one every failure is Fail.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAIL, SKIP, DEAD_LETTER, RETRY = "fail", "skip", "dead_letter", "retry"
ACTIONS = (FAIL, SKIP, DEAD_LETTER, RETRY)
#: Fixed value: the reason of a filter without one of its own.
FILTER_REASON = "Item did not meet filter criteria."


@dataclass(frozen=True)
class Rule:
    """ok: true where the row passes; value: the column that the report shows."""

    name: str
    ok: Column
    column: str | None = None
    message: str | None = None
    kind: str = "validation"


def filter_rule(ok: Column, reason: str = FILTER_REASON, name: str = "filter") -> Rule:
    return Rule(name, ok, None, reason, "filter")


def conversion_rule(column: str, converted: Column, target: str) -> Rule:
    return Rule(f"convert to {target}", converted.isNotNull(), column, f"Value cannot be converted to {target}.", "conversion")


def same_rule_for(columns: Sequence[str], name: str, test) -> list[Rule]:
    """One predicate for several columns."""
    return [Rule(name, test(c), c) for c in columns]


@dataclass(frozen=True)
class Policy:
    """What to do with each kind of failure; `otherwise` for kinds not named."""

    actions: dict[str, str] = field(default_factory=dict)
    otherwise: str = FAIL

    def __post_init__(self):
        if wrong := [a for a in (*self.actions.values(), self.otherwise) if a not in ACTIONS]:
            raise ValueError(f"unknown actions {wrong}; there are {ACTIONS}")

    def on(self, kind: str, action: str) -> Policy:
        return Policy(self.actions | {kind: action}, self.otherwise)

    def action(self, kind: str) -> str:
        return self.actions.get(kind, self.otherwise)

    def action_for(self, error: BaseException) -> str:
        """For user code: the action named for the class of an error, or for the nearest of its base classes."""
        return next((self.actions[c.__name__] for c in type(error).__mro__ if c.__name__ in self.actions), self.otherwise)


#: Drops what filters, validations or conversions refuse, and fails on anything else.
SKIP_REFUSED = Policy({"filter": SKIP, "validation": SKIP, "conversion": SKIP})
TO_DEAD_LETTERS = Policy({"filter": DEAD_LETTER, "validation": DEAD_LETTER, "conversion": DEAD_LETTER})


def failure(rules: Sequence[Rule]) -> Column:
    """Struct (rule, kind, column, value, message) of the first broken rule; null if none is."""
    kind = "struct<rule:string,kind:string,column:string,value:string,message:string>"
    out = F.lit(None).cast(kind)
    for r in reversed(rules):
        value = F.col(r.column).cast("string") if r.column else F.lit(None).cast("string")
        report = F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.column).cast("string").alias("column"), value.alias("value"),
            F.lit(r.message or f"Validation failed for rule '{r.name}'.").alias("message"),
        ).cast(kind)
        out = F.when(~F.coalesce(r.ok, F.lit(False)), report).otherwise(out)
    return out


def with_failure(df: DataFrame, rules: Sequence[Rule], name: str = "failure") -> DataFrame:
    return df.withColumn(name, failure(rules))


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows that don't with their failure; two filters over one scan."""
    marked = with_failure(df, rules, "_failure")
    passed = marked.where(F.col("_failure").isNull()).drop("_failure")
    refused = marked.where(F.col("_failure").isNotNull()).select(*df.columns, "_failure.*")
    return passed, refused


def apply_rules(df: DataFrame, rules: Sequence[Rule], policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """Rows that stay and dead letters, by the policy. A row whose failure means Fail stops the job when it is read.

    No rules: everything passes. Retry is refused: a rule gives a row the same answer every
    time; transforms.per_item() retries work that may go better the next time.
    """
    if not rules:
        return df, df.limit(0)
    if again := sorted({r.name for r in rules if policy.action(r.kind) == RETRY}):
        raise ValueError(f"rules can't be retried: {again}")
    marked = with_failure(df, rules, "_failure")
    fatal = [r.kind for r in rules if policy.action(r.kind) == FAIL]
    letters = [r.kind for r in rules if policy.action(r.kind) == DEAD_LETTER]
    stays = F.col("_failure").isNull()
    if fatal:
        said = F.concat(F.lit("rule broken: "), F.col("_failure.rule"), F.lit(": "), F.col("_failure.message"))
        stays = F.when(F.col("_failure.kind").isin(*fatal), F.raise_error(said).cast("boolean")).otherwise(stays)
    kept = marked.where(stays).drop("_failure")
    dead = marked.where(F.col("_failure.kind").isin(*letters) if letters else F.lit(False)).select(*df.columns, "_failure.*")
    return kept, dead
