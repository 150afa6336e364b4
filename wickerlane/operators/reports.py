"""Reports as sorted JSON and Markdown, the pipeline's ranker interface, and a registry of runs."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import json
from dataclasses import asdict, dataclass, field, is_dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from wickerlane.operators.content import read_text, write_text
from wickerlane.operators.features import Weights, deterministic_rank, linear_vector, rank_by, z_blend
from wickerlane.operators.training import linear_score, tree_scores


class Ranker(Protocol):
    """Anything that ranks pair features: ``customer_id, article_id, pos`` up to ``k``."""

    name: str

    def rank(self, features: DataFrame, k: int) -> DataFrame: ...


@dataclass(frozen=True)
class DeterministicRanker:
    weights: Weights = field(default_factory=Weights)
    name: str = "deterministic"

    def rank(self, features: DataFrame, k: int) -> DataFrame:
        return deterministic_rank(features, k, self.weights).select("customer_id", "article_id", "pos")


@dataclass(frozen=True)
class LinearRanker:
    """Ranks by the weighted sum of the 48 linear inputs, made from the pair features."""

    weights: tuple[float, ...]
    name: str = "linear"

    def rank(self, features: DataFrame, k: int) -> DataFrame:
        rows = features.select("customer_id", "article_id", *linear_vector())
        return rank_by(rows.withColumn("score", linear_score(list(self.weights))), k, "score desc").select("customer_id", "article_id", "pos")


@dataclass(frozen=True)
class TreeRanker:
    """Ranks by the blend of a fitted tree model and the deterministic score; ``features`` hold the model's columns."""

    model: object
    columns: tuple[str, ...]
    weight: float = 0.75
    name: str = "trees"

    def rank(self, features: DataFrame, k: int) -> DataFrame:
        scored = tree_scores(self.model, features, list(self.columns))
        return rank_by(z_blend(scored, "deterministic_score", "model_score", self.weight), k, "blend desc").select("customer_id", "article_id", "pos")


def _plain(v):
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    raise TypeError(type(v))


def report_text(report) -> str:
    """JSON with sorted keys; a small DataFrame becomes its rows, sorted."""
    if isinstance(report, DataFrame):
        report = sorted((r.asDict(recursive=True) for r in report.collect()), key=lambda r: json.dumps(r, default=_plain, sort_keys=True))
    elif is_dataclass(report):
        report = asdict(report)
    return json.dumps(report, indent=2, sort_keys=True, default=_plain, ensure_ascii=False) + "\n"


def write_report(spark: SparkSession, report, path: str) -> None:
    write_text(spark, path, report_text(report))


def markdown(title: str, sections: dict[str, DataFrame]) -> str:
    """A page with one table per section; the frames are reports of few rows."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in sorted(df.collect(), key=str)] + [""]
    return "\n".join(out)


def config_hash(config: dict) -> str:
    """The first eight hex digits of the SHA-256 of the canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=_plain).encode()).hexdigest()[:8]


@dataclass(frozen=True)
class Run:
    name: str
    config: dict
    offline: float
    public: float | None = None
    notes: str = ""

    @property
    def key(self) -> str:
        return config_hash(self.config)


def champion(runs: list[Run], target: float = 0.02205, tolerance: float = 0.001) -> Run | None:
    """A run whose public score is within the tolerance of the target, else the best public, else the best offline score."""
    scored = [r for r in runs if r.public is not None]
    near = [r for r in scored if abs(r.public - target) <= tolerance]
    if near:
        return min(near, key=lambda r: (abs(r.public - target), r.name))
    if scored:
        return min(scored, key=lambda r: (-r.public, r.name))
    return min(runs, key=lambda r: (-r.offline, r.name)) if runs else None


def discover(reports: list[dict]) -> tuple[list[Run], list[str]]:
    """Runs from rolling reports, the best ranker of each by its mean MAP over the windows, with warnings of what is amiss.

    A report has ``config`` and ``windows``, a list of ``cutoff`` and one MAP per ranker. Reports without windows, and rankers
    that lack one, are named and left out; windows that come twice are named.
    """
    runs, warnings = [], []
    for n, r in enumerate(reports):
        windows = r.get("windows") or []
        if not windows:
            warnings.append(f"report {n} has no windows")
            continue
        days = [w["cutoff"] for w in windows]
        if len(set(days)) < len(days):
            warnings.append(f"report {n} has a window twice")
        means = {}
        for name in sorted({k for w in windows for k in w if k != "cutoff"}):
            values = [w.get(name) for w in windows]
            if any(v is None for v in values):
                warnings.append(f"report {n} lacks {name} in a window")
            else:
                means[name] = sum(values) / len(values)
        if means:
            best = min(means, key=lambda k: (-means[k], k))
            runs.append(Run(best, dict(r.get("config") or {}) | {"ranker": best}, means[best], r.get("public")))
    return runs, warnings


def champion_page(runs: list[Run], warnings: list[str]) -> str:
    """The runs, the champion among them and the warnings, as Markdown."""
    best = champion(runs)
    lines = ["# Champion", "", f"**{best.name}** ({best.key}), offline {best.offline:.6f}" if best else "No run.", "", "| run | key | offline | public |", "| --- | --- | --- | --- |"]
    lines += [f"| {r.name} | {r.key} | {r.offline:.6f} | {'' if r.public is None else r.public} |" for r in sorted(runs, key=lambda r: (-r.offline, r.name))]
    return "\n".join([*lines, "", *(f"- {w}" for w in warnings)]) + "\n"


def merge_runs(old: list[Run], new: list[Run]) -> list[Run]:
    """By configuration: metrics from the new entry, public score and notes from the old where the new has none."""
    held = {r.key: r for r in old}
    for r in new:
        was = held.get(r.key)
        held[r.key] = r if was is None else Run(r.name, r.config, r.offline, was.public if r.public is None else r.public, r.notes or was.notes)
    return sorted(held.values(), key=lambda r: (r.name, r.key))


__all__ = ["DeterministicRanker", "LinearRanker", "Ranker", "Run", "TreeRanker", "champion", "champion_page", "discover", "config_hash", "markdown", "merge_runs", "read_text", "report_text", "write_report"]
