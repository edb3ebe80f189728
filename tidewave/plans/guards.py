"""Guards over an evaluation, waivers, and what a report says or refuses to say."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field

from tidewave.errors import ExperimentError, GuardViolation
from tidewave.model import JOINTS, GuardName, Measurement, Protocol, Split

MARGIN = 0.9


@dataclass(frozen=True)
class Waiver:
    """Lets one failed guard pass: a reason of 40 characters and 8 different words, a name, up to 90 days ahead."""

    guard: GuardName
    reason: str
    approved_by: str
    expires_on: dt.date

    def __post_init__(self) -> None:
        ahead = (self.expires_on - dt.date.today()).days
        if len(self.reason.strip()) < 40 or len(set(self.reason.lower().split())) < 8 or not self.approved_by.strip() or ahead > 90:
            raise ValueError("a waiver needs a reason of 40 characters and 8 words, an approver and an end within 90 days")

    def holds(self, today: dt.date | None = None) -> bool:
        return self.expires_on > (today or dt.date.today())


@dataclass(frozen=True)
class Finding:
    guard: GuardName
    passed: bool
    message: str
    detail: dict = field(default_factory=dict)
    waiver: Waiver | None = None

    @property
    def blocking(self) -> bool:
        return not self.passed and not (self.waiver and self.waiver.guard is self.guard and self.waiver.holds())

    def describe(self) -> str:
        state = "ok" if self.passed else "BLOCKING" if self.blocking else f"waived by {self.waiver.approved_by} to {self.waiver.expires_on}"
        return f"[{state}] {self.guard.value}: {self.message}"


@dataclass(frozen=True)
class Binding:
    """What guards were run on: the split, the dataset, how many rows stood on either side, and which ones."""

    split: Split
    dataset: str
    dataset_version: str
    n_train: int
    n_test: int
    fingerprint: str

    def __post_init__(self) -> None:
        if self.n_train < 1 or self.n_test < 1 or not self.fingerprint:
            raise ExperimentError("guards are bound to training and test rows and their fingerprint")

    def disagreement(self, p: Protocol) -> str | None:
        """Why these guards say nothing of a result under a protocol; None where they do."""
        pairs = (("split", self.split.name, p.split.name), ("dataset", self.dataset, p.dataset), ("version", self.dataset_version, p.dataset_version))
        return "; ".join(f"the guards saw {what} {mine}, the rows {theirs}" for what, mine, theirs in pairs if mine != theirs) or None

    def describe(self) -> str:
        return f"guards on {self.split.name}, {self.n_test} test rows of {self.dataset} {self.dataset_version}, fingerprint {self.fingerprint[:12]}"

    def as_dict(self) -> dict:
        return {"split": self.split.name, "dataset": self.dataset, "dataset_version": self.dataset_version, "n_train": self.n_train, "n_test": self.n_test, "fingerprint": self.fingerprint}


@dataclass(frozen=True)
class GuardReport:
    """Findings of all three guards, bound to what they were made on."""

    findings: tuple[Finding, ...]
    binding: Binding

    def __post_init__(self) -> None:
        missing = set(GuardName) - {f.guard for f in self.findings}
        if missing or len(self.findings) != len(GuardName):
            raise ExperimentError(f"guards missing or repeated: {sorted(m.value for m in missing)}")

    @property
    def blocking(self) -> list[Finding]:
        return [f for f in self.findings if f.blocking]

    def bound_to(self, p: Protocol) -> bool:
        return self.binding.disagreement(p) is None

    def require_clean(self) -> None:
        if self.blocking:
            raise GuardViolation("\n".join(f.describe() for f in self.blocking))

    def describe(self) -> str:
        return "\n".join([self.binding.describe(), *(f.describe() for f in self.findings)])


def require_protocol(protocol: Protocol, split: Split) -> None:
    """A protocol speaks of its own split; no result is relabelled."""
    if protocol.split is not split:
        raise ExperimentError(f"the protocol declares {protocol.split.name}, the folds are {split.name}")


def run_guards(family, said, protocol: Protocol, waivers: tuple[Waiver, ...] = (), decimals: int = 2) -> GuardReport:
    """The three guards of a family of folds and a model's predictions (fold, sample_id, guess).

    Concentration and the size of the evaluation look at the test rows of all folds together; whether labels match is
    asked of every fold, since a fold that leaves one unit out holds nobody else to compare.
    """
    from pyspark.sql import functions as F

    from tidewave.operators import poses

    require_protocol(protocol, family.split)
    by = {w.guard: w for w in waivers}
    within = not protocol.split.is_population
    test = family.test()
    a = poses.concentration(test).first()
    if a is None or not a["total"]:
        raise ExperimentError("the test set is empty")
    found = [Finding(GuardName.CONCENTRATION, within or a["passed"], f"{a['participant']} has {a['share']:.0%} of test samples", a.asDict(), by.get(GuardName.CONCENTRATION))]
    if within:
        found.append(Finding(GuardName.LABEL_MATCH, True, "not asked within users", {}, by.get(GuardName.LABEL_MATCH)))
    else:
        matches = poses.fold_label_matches(family.samples, protocol.split) if family.by_unit else poses.label_matches(poses.vector_sums(family.train(), ["fold", "participant"]), poses.vector_sums(test, ["fold", "participant"]))
        rows = sorted(matches.collect(), key=lambda r: (r["passed"], r["ratio"] if r["ratio"] is not None else -1.0, r["fold"]))  # a row a fold
        worst = rows[0]
        ratio = "no typical distance" if worst["ratio"] is None else f"nearest person at {worst['ratio']:.2f} of the usual distance"
        failed = [r["fold"] for r in rows if not r["passed"]]
        found.append(Finding(GuardName.LABEL_MATCH, not failed, f"{len(failed)} of {len(rows)} folds match their training labels; in {worst['fold']} {ratio}", {"failed": failed, "worst": worst.asDict()}, by.get(GuardName.LABEL_MATCH)))
    errors = said.join(test, ["fold", "sample_id"]).withColumn("error", poses.mean_of(poses.joint_errors(F.col("guess"), F.col("pose"))))
    # pooled over folds there are many sessions, within users too; the blocks of one session are for one fold alone
    clusters = errors.select(F.concat_ws("/", "participant", "session").alias("cluster"), "error")
    least = 5 if protocol.split.is_population else 2
    c = poses.evaluation_size(clusters, "cluster", least, decimals).first()
    why = f"fewer than {least}" if c["clusters"] < least else f"supports {c['decimals']} decimals, {decimals} are printed"
    found.append(Finding(GuardName.EVALUATION_SIZE, c["passed"], f"{c['clusters']} clusters, standard error {c['sem'] or 0:.3g}, {why}", c.asDict() | {"reported_decimals": decimals}, by.get(GuardName.EVALUATION_SIZE)))
    n_train, n_test, fingerprint = family.identity()
    return GuardReport(tuple(found), Binding(protocol.split, protocol.dataset, protocol.dataset_version, n_train, n_test, fingerprint))


@dataclass(frozen=True)
class Row:
    name: str
    kind: str  # model or baseline
    mpjpe: Measurement
    others: dict = field(default_factory=dict)


@dataclass
class Report:
    """Rows of one split; no headline while anything is missing."""

    rows: list[Row] = field(default_factory=list)
    guards: GuardReport | None = None

    def add(self, row: Row) -> None:
        if row.kind not in ("model", "baseline"):
            raise ExperimentError(f"unknown kind {row.kind!r}")
        if self.rows and not row.mpjpe.comparable_to(self.rows[0].mpjpe):
            raise ExperimentError(f"{row.name} was not measured as {self.rows[0].name} was")
        self.rows.append(row)

    @property
    def protocol(self) -> Protocol:
        return self.rows[0].mpjpe.protocol

    def attach(self, guards: GuardReport) -> None:
        """Takes guards that were run on the rows' split and dataset, and no others."""
        if not self.rows:
            raise ExperimentError("guards without rows")
        if wrong := guards.binding.disagreement(self.protocol):
            raise ExperimentError(wrong)
        self.guards = guards

    def best(self, kind: str) -> Row | None:
        return min((r for r in self.rows if r.kind == kind), key=lambda r: r.mpjpe.value, default=None)

    def beaten(self) -> list[str]:
        model = self.best("model")
        return [r.name for r in self.rows if r.kind == "baseline" and model and model.mpjpe.value < MARGIN * r.mpjpe.value]

    def refusals(self, in_set: bool = False) -> list[str]:
        if not self.rows:
            return ["no rows"]
        out = [] if in_set or self.protocol.split.is_honest else ["only a within-session split was measured"]
        out += ["no model"] * (self.best("model") is None) + ["no baseline"] * (self.best("baseline") is None)
        if self.guards is None:
            return [*out, "the guards were not run"]
        out += ["guards block: " + ", ".join(f.guard.value for f in self.guards.blocking)] * bool(self.guards.blocking)
        wrong = self.guards.binding.disagreement(self.protocol)
        return out + ([wrong] if wrong else [])

    def headline(self, in_set: bool = False) -> str:
        if refused := self.refusals(in_set):
            return "NO HEADLINE: " + "; ".join(refused)
        model = self.best("model")
        weak = [r.name for r in self.rows if r.kind == "baseline" and r.name not in self.beaten()]
        return f"{model.name}: {model.mpjpe.value:.2f} {model.mpjpe.unit} ({self.protocol.describe()})" + (f"; does NOT clearly beat {', '.join(weak)}" if weak else "")

    def verdict(self) -> str:
        """One line: what may be said of the model against its baselines."""
        if self.refusals(in_set=True):
            return "no verdict"
        weak = [r.name for r in self.rows if r.kind == "baseline" and r.name not in self.beaten()]
        return f"fails to beat {', '.join(weak)} by {1 - MARGIN:.0%}" if weak else f"beats {', '.join(self.beaten())} by {1 - MARGIN:.0%} or more"

    def validity(self) -> str:
        p = self.protocol
        unmeasured = [s.name.lower() for s in Split if s > p.split] + ["held-out poses"] * (not p.held_out_poses)
        return "\n".join([f"Measured: {p.describe()}", *(f"UNMEASURED: {u}" for u in unmeasured)])

    def table(self) -> str:
        """Rows by their error, with the five numbers of each."""
        number = lambda x, digits=2: f"{x:>10.{digits}f}" if x is not None else f"{'-':>10}"
        lines = [f"{'name':<20}{'kind':<10}{'MPJPE21':>10}{'MPJPE20':>10}{'PA':>10}{'tips':>10}{'PCK':>10}"]
        for r in sorted(self.rows, key=lambda r: r.mpjpe.value):
            o = r.others.get
            lines.append(f"{r.name:<20}{r.kind:<10}" + number(r.mpjpe.value) + number(o("mpjpe_excl_root")) + number(o("pa_mpjpe")) + number(o("fingertips")) + number(o("pck"), 3))
        return "\n".join(lines)

    def joints(self, name: str, worst: int = 5) -> str:
        """The joints of a row with the largest errors, fingertips against the rest."""
        row = next(r for r in self.rows if r.name == name)
        per = row.others["per_joint"]
        order = sorted(range(len(per)), key=lambda j: (-per[j], j))[:worst]
        tips, rest = row.others.get("fingertips"), row.others.get("rest")
        lines = [f"{JOINTS[j]:<14}{per[j]:>8.2f} mm" for j in order]
        return "\n".join([*lines, f"fingertips {tips:.2f} mm, other joints {rest:.2f} mm" if tips is not None and rest is not None else "no fingertips"])

    def text(self) -> str:
        model = self.best("model")
        parts = [self.headline(True), self.verdict(), self.table(), self.validity()]
        parts += [self.guards.describe()] if self.guards else []
        parts += [self.joints(model.name)] if model and "per_joint" in model.others else []
        return "\n\n".join(parts)

    def as_dict(self) -> dict:
        return {"headline": self.headline(), "verdict": self.verdict(), "refusals": self.refusals(), "rows": [{"name": r.name, "kind": r.kind, "mpjpe": r.mpjpe.value, "samples": r.mpjpe.samples, **r.others} for r in self.rows], "guards": [f.describe() for f in self.guards.findings] if self.guards else None, "binding": self.guards.binding.as_dict() if self.guards else None}

    def as_json(self) -> str:
        return json.dumps(self.as_dict(), indent=2)


@dataclass
class ReportSet:
    """One report for each split; the headline is the strongest split's, never the best number."""

    reports: dict[Split, Report] = field(default_factory=dict)
    absences: dict[Split, str] = field(default_factory=dict)
    experiments: dict = field(default_factory=dict)

    def absence(self, split: Split) -> str | None:
        """Why a split was not measured; None if it was."""
        return None if split in self.reports else self.absences.get(split, "not asked for")

    def as_json(self) -> str:
        return json.dumps({"headline": self.headline(), "refusals": self.refusals(), "splits": {s.name.lower(): r.as_dict() for s, r in sorted(self.reports.items())}, "absences": {s.name.lower(): self.absence(s) for s in Split if s not in self.reports}}, indent=2)

    def add(self, report: Report) -> None:
        split = report.protocol.split
        if split in self.reports:
            raise ExperimentError(f"{split.name} is there already")
        self.reports[split] = report

    def refusals(self) -> list[str]:
        if not self.reports:
            return ["no reports"]
        missing = [s for s in Split if s.is_honest and s not in self.reports]
        out = ["not measured: " + ", ".join(s.name for s in missing)] if missing else []
        out += [f"{s.name}: {r}" for s, x in sorted(self.reports.items()) for r in x.refusals(in_set=True)]
        models = {tuple(sorted(r.name for r in x.rows if r.kind == "model")) for x in self.reports.values()}
        return out + ["the splits measure different models"] * (len(models) > 1)

    def headline(self) -> str:
        refused = self.refusals()
        return "NO HEADLINE: " + "; ".join(refused) if refused else self.reports[max(self.reports)].headline(in_set=True)

    def table(self) -> str:
        out = []
        for s in Split:
            r = self.reports.get(s)
            m, b = (r.best("model"), r.best("baseline")) if r else (None, None)
            out.append(f"{s.name:<16}" + (f"{m.mpjpe.value:>10.2f}" if m else f"{'NOT MEASURED':>14} {self.absences.get(s, '')}") + (f"  {b.name} {b.mpjpe.value:.2f}" if b else ""))
        return "\n".join(out)
