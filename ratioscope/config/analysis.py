"""How data are analysed; every list is a dimension of the parameter sweep."""

from __future__ import annotations

from .manifest import Manifest
from .spec import Spec, choice, duration, flag, many, micros, number, stamp, sub, text


class OutputGridConfig(Spec):
    freq = duration()
    start = stamp(None)
    end = stamp(None)
    bin_statistic = choice("mean", "median", default="mean")

    def check(self):
        return "start must be before end" if self.start and self.end and self.start >= self.end else None


class AlignmentConfig(Spec):
    max_interp_gap = duration("10s")


class BaselineConfig(Spec):
    windows = many(duration(), least=1)
    quantiles = many(number(gt=0, le=0.5), least=1)
    min_valid_fraction = number(0.5, gt=0, le=1)

    def check(self):
        w = [micros(x) for x in self.windows]
        if any(b <= a for a, b in zip(w, w[1:])):
            return "windows must get longer from one to the next"
        return "a quantile is given twice" if len(set(self.quantiles)) < len(self.quantiles) else None


class DetectionConfig(Spec):
    enter_sigma = many(number(), (3.0,), least=1)
    exit_sigma = number(1.0, gt=0)
    noise_estimator = choice("diff_mad", "mad", "diff_qn", "qn", default="diff_mad")
    noise_window = duration("10min")
    min_duration = duration("3s")
    max_internal_gap = duration("5s")

    def check(self):
        low = [e for e in self.enter_sigma if e <= self.exit_sigma]
        return f"enter_sigma {low} must exceed exit_sigma {self.exit_sigma}" if low else None


class SmoothingConfig(Spec):
    enabled = flag(False)
    cutoff_periods = many(duration(), ("60s",), least=1)
    order = number(4, ge=1, le=10, whole=True)


class ClusteringConfig(Spec):
    enabled = flag(False)
    eps_m = number(500.0, gt=0)
    space_time_scale = number(1.0, gt=0)
    min_samples = number(2, ge=1, whole=True)


class RegressionConfig(Spec):
    reference_species = text(filled=True)
    methods = many(choice("ols", "york", "odr"), ("ols", "york"), least=1)
    min_points = number(8, ge=3, whole=True)
    confidence_level = number(0.95, gt=0, lt=1)

    def check(self):
        return "a method is given twice" if len(set(self.methods)) < len(self.methods) else None


class AnalysisConfig(Spec):
    output_grid = sub(OutputGridConfig)
    alignment = sub(AlignmentConfig, AlignmentConfig)
    baseline = sub(BaselineConfig)
    detection = sub(DetectionConfig, DetectionConfig)
    smoothing = sub(SmoothingConfig, SmoothingConfig)
    clustering = sub(ClusteringConfig, ClusteringConfig)
    regression = sub(RegressionConfig)

    def check(self):
        short, grid = self.baseline.windows[0], self.output_grid.freq
        return f"the shortest window {short} must be at least 10 times the grid spacing {grid}" if micros(short) < 10 * micros(grid) else None


class RunConfig(Spec):
    """A manifest with the analysis of its data."""

    manifest = sub(Manifest)
    analysis = sub(AnalysisConfig)

    def check(self):
        ref = self.analysis.regression.reference_species
        return f"reference_species {ref!r} is not among the gases {sorted(self.manifest.gas_species)}" if ref not in self.manifest.gas_species else None
