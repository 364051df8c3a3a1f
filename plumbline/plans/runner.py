"""Presets: a declared list of analyses over columns bound to business concepts.

Each step becomes an independent frame. Rows that come from a join or another dear plan are written once, as every step and
every quantile in it reads them again.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache, reduce
from pathlib import Path

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import Contract, Measure, Window
from ..errors import Refused
from ..functions.aggs import NUMERIC
from ..functions.staging import settled
from ..operators import describe, growth, infer, keywords, people, presets_filters, relate, temporal
from ..operators.scope import Scope

FILE = Path(__file__).with_name("presets.yaml")

ANALYSES = {f.__name__: f for f in (
    describe.top_n, describe.group_compare, describe.pareto, describe.cross_tab, describe.frequency,
    temporal.trend, temporal.period_compare, temporal.growth_decomposition, relate.changepoint,
    infer.sample_adequacy, people.repeat_behaviour, growth.funnel, growth.source_reconciliation,
    growth.ab_test, growth.pacing, growth.text_ngrams, growth.key_overlap,
    growth.expected_rate_by_bucket, growth.before_after_baseline, growth.unit_economics,
    growth.marginal_returns, growth.rate_mix_shift, growth.group_map_totals)}


class Unbound(Exception):
    """A step names a concept, metric or parameter that is not there."""


@dataclass
class Request:
    df: DataFrame
    bindings: dict[str, str]
    params: dict = field(default_factory=dict)
    group_map: DataFrame | None = None
    window: Window | None = None
    metrics: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class StepResult:
    title: str
    analysis: str
    frame: DataFrame | None
    refused: str | None = None


@cache
def declarations() -> dict:
    return yaml.safe_load(FILE.read_text())


def preset_names() -> list[str]:
    return list(declarations()["presets"])


def metric_measures(r: Request) -> tuple[Measure, ...]:
    """Every metric whose parts are all bound, as a ratio of sums or a comparison."""
    def column(term: str) -> str:
        sign = "-" if term.startswith("-") else ""
        return sign + r.bindings[term.lstrip("-")]

    out = []
    for name, m in {**declarations()["metrics"], **r.metrics}.items():
        if "compare" in m:
            left, op, right = m["compare"]
            parts = [left] + ([right] if isinstance(right, str) else [])
            if all(p in r.bindings for p in parts):
                rhs = r.bindings[right] if isinstance(right, str) else right
                out.append(Measure(name, "mean", compare=(r.bindings[left], op, rhs)))
        elif all(t.lstrip("-") in r.bindings for t in (*m["n"], *m["d"])):
            out.append(Measure(name, "ratio", numerator=tuple(column(t) for t in m["n"]),
                               denominator=tuple(column(t) for t in m["d"]),
                               scale=float(m.get("scale", 1))))
    return tuple(out)


def contract_of(r: Request) -> Contract:
    columns = list(dict.fromkeys(r.bindings.values()))
    types = {f.name: f.dataType for f in r.df.schema.fields}
    totals = tuple(Measure(c, "sum") for c in columns if isinstance(types[c], NUMERIC))
    date = r.bindings.get("date") or r.bindings.get("created_at")
    return Contract("preset", date_column=date, window=r.window, measures=totals + metric_measures(r),
                    dimensions=tuple(columns))


def _choice(r: Request, preset: dict, slot: str) -> str:
    for concept in preset[slot]:
        if concept in r.bindings:
            return r.bindings[concept]
    raise Unbound(f"none of {', '.join(preset[slot])} is bound")


def resolve(value, r: Request, preset: dict, measures: set[str]):
    if isinstance(value, dict):
        return {k: resolve(v, r, preset, measures) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, r, preset, measures) for v in value]
    if not (isinstance(value, str) and value.startswith("$")):
        return value
    ref = value[1:]
    if ref.startswith("metric."):
        name = ref.split(".", 1)[1]
        if name not in measures:
            raise Unbound(f"metric {name} has unbound parts")
        return name
    if ref.startswith("optional."):
        return r.params.get(ref.split(".", 1)[1])
    if ref.startswith("param."):
        name, _, default = ref.split(".", 1)[1].partition("=")
        if name in r.params:
            return r.params[name]
        if not default:
            raise Refused("PARAMETER_NEEDED", name)
        return int(default) if default.isdigit() else default
    if ref in ("by", "value", "text"):
        return _choice(r, preset, ref)
    if ref not in r.bindings:
        raise Unbound(f"{ref} is not bound")
    return r.bindings[ref]


def _filters(items, r, preset, measures) -> list[dict]:
    """Filter steps with their columns resolved; one that reads an unbound column is left out."""
    out = []
    for item in items or []:
        try:
            out.append(resolve(item, r, preset, measures))
        except Unbound:
            continue
    return out


def _validity(r: Request, preset: dict, used: set[str], measures: set[str]) -> list[dict]:
    rules = []
    for name in preset.get("validity", []):
        rule = dict(declarations()["validity"][name])
        only = rule.pop("for", None)
        if only is None or set(only) & used:
            rules += _filters([rule], r, preset, measures)
    return rules


def _focused(scope: Scope, preset: dict, r: Request, measures: set[str]) -> Scope:
    focus = preset.get("focus")
    if not focus:
        return scope
    f = resolve(focus, r, preset, measures)
    if f.get("member"):
        named = presets_filters.match_values(scope.df, f["dimension"], [f["member"]], {}).first()
        if named["value"] is None:
            raise Refused("UNKNOWN_MEMBER", str(f["member"]))
        return Scope(scope.df.where(F.col(f["dimension"]).cast("string") == named["value"]),
                     scope.contract)
    return presets_filters.focus_worst(scope, f["dimension"], f["measure"])


def _run(analysis: str, scope: Scope, args: dict, r: Request) -> DataFrame:
    args = {k: v for k, v in args.items() if v is not None}
    if analysis == "keyword_grouping":
        return keywords.group_keywords(scope.df, args["column"])
    if analysis == "bivariate":
        ratio = scope.contract.measure(args["measure"]).agg == "ratio"
        return (relate.rate_by_bins if ratio else relate.bivariate)(scope, **args)
    if analysis == "group_map_totals":
        if r.group_map is None:
            raise Refused("NO_GROUPS_APPROVED", "approve keyword groups first")
        return growth.group_map_totals(scope, group_map=r.group_map, **args)
    for k in ("steps", "measures"):
        if isinstance(args.get(k), str):
            args[k] = [s.strip() for s in args[k].split(",")]
    return ANALYSES[analysis](scope, **args)


def run_preset(name: str, r: Request) -> list[StepResult]:
    """Every step of a preset that its bindings allow; a refused step says why."""
    preset = declarations()["presets"].get(name)
    if preset is None:
        raise Refused("UNKNOWN_PRESET", name)
    missing = [c for c in preset.get("needs", []) if c not in r.bindings]
    if missing:
        raise Refused("CONCEPT_NOT_BOUND", ", ".join(missing))
    contract = contract_of(r)
    measures = {m.name for m in contract.measures}
    df = settled(r.df)
    out = []
    for step in preset["steps"]:
        analysis = next(k for k in step if k not in ("title", "optional", "filter"))
        try:
            args = resolve(step[analysis], r, preset, measures)
            used = {v for v in args.values() if isinstance(v, str)}
            if "focus" in preset:
                used.add(resolve(preset["focus"]["measure"], r, preset, measures))
            scope = Scope.of(df, contract)
            keep = (_validity(r, preset, used, measures) + _filters(preset.get("keep"), r, preset, measures))
            scope = Scope(presets_filters.filtered(scope.df, keep), contract)
            scope = _focused(scope, preset, r, measures)
            own = _filters(step.get("filter"), r, preset, measures)
            scope = Scope(presets_filters.filtered(scope.df, own), contract)
            out.append(StepResult(step["title"], analysis, _run(analysis, scope, args, r)))
        except Unbound as exc:
            if not step.get("optional"):
                raise Refused("CONCEPT_NOT_BOUND", str(exc)) from None
            out.append(StepResult(step["title"], analysis, None, f"CONCEPT_NOT_BOUND: {exc}"))
        except Refused as exc:
            out.append(StepResult(step["title"], analysis, None, str(exc)))
    if all(s.frame is None for s in out):
        raise Refused("NOTHING_TO_SHOW", "; ".join(s.refused or "" for s in out))
    return out


#: Columns that say what a figure is about, per analysis.
LABELS = {"top_n": ["member"], "group_compare": ["level", "member"], "pareto": ["member", "reaches"],
          "cross_tab": ["kind", "row_member", "column_member"], "frequency": ["value"],
          "trend": ["period", "series", "member"], "growth_decomposition": ["member", "entrant", "leaver"],
          "rate_mix_shift": ["level", "member", "simpson"], "bivariate": ["bin"],
          "changepoint": ["split_after"], "group_map_totals": ["group", "period", "top_member"]}


def figures(results: list[StepResult]) -> DataFrame:
    """All steps as one long frame: step, label, figure, value."""
    parts = []
    for s in results:
        if s.frame is None:
            continue
        labels = [c for c in LABELS.get(s.analysis, []) if c in s.frame.columns]
        numbers = [f.name for f in s.frame.schema.fields if f.name not in labels
                   and isinstance(f.dataType, (*NUMERIC, T.DecimalType))]
        label = F.concat_ws(" | ", *[F.col(c).cast("string") for c in labels])
        wide = s.frame.select(label.alias("label"), *[F.col(c).cast("double").alias(c) for c in numbers])
        long = wide.unpivot(["label"], numbers, "figure", "value").where(F.col("value").isNotNull())
        parts.append(long.select(F.lit(s.title).alias("step"), "label", "figure", "value"))
    return reduce(DataFrame.unionByName, parts)
