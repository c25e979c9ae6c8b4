"""Settings of a run and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from rohspark.sources.builds import CENTROMERES


@dataclass
class RohConfig:
    """All settings, with their defaults. A cutoff or bounds of None are found from the data."""

    tped: str | None = None
    tfam: str | None = None
    vcf: str | None = None
    tgls: str | None = None
    gl_type: str | None = None
    map: str | None = None
    freq_file: str | None = None
    freq_only: bool = False
    centromere: str | None = None
    build: str | None = None
    out: str = "outfile"
    tped_missing: str = "0"
    error: float = -1.0
    winsize: int = 0
    winsize_multi: list[int] = field(default_factory=list)
    auto_winsize: bool = False
    auto_winsize_step: int = 10
    max_winsize: int = 500
    max_gap: int = 200_000
    overlap_frac: float = 0.25
    auto_overlap_frac: bool = False
    resample: int = 0
    weighted: bool = False
    phased: bool = False
    M: int = 7
    mu: float = 1e-9
    cm: bool = False
    raw_lod: bool = False
    lod_cutoff: float | None = None
    size_bounds: list[float] = field(default_factory=list)
    nclust: int = 3
    kde_subsample: int = 20
    ld_subsample: int = 0
    no_kde_thinning: bool = False
    seed: int = 0

    def problems(self) -> tuple[list[str], list[str]]:
        """(errors, warnings)."""
        e: list[str] = []
        w: list[str] = []

        def need(ok: bool, text: str) -> None:
            if not ok:
                e.append(text)

        need(bool(self.vcf) or bool(self.tped and self.tfam), "tped and tfam are needed, or vcf")
        need(not self.cm or bool(self.map), "cm needs map")
        need(not self.weighted or bool(self.map), "weighted needs map")
        need(self.nclust > 0, "nclust must be above 0")
        need(self.M > 0, "M must be above 0")
        need(0 < self.mu < 1, "mu must lie between 0 and 1")
        need(self.build in (None, "none", *CENTROMERES), f"build must be one of {', '.join(CENTROMERES)}, none")
        need(bool(self.build or self.centromere), "build or centromere is needed")
        need(all(n > 1 for n in self.winsize_multi), "window sizes must be above 1")
        need(not (self.freq_file and self.freq_only), "freq_file and freq_only exclude each other")
        need(self.auto_winsize_step > 0, "auto_winsize_step must be above 0")
        need(all(b > 0 for b in self.size_bounds) and all(a < b for a, b in zip(self.size_bounds, self.size_bounds[1:])), "size_bounds must be positive and rise")
        need(bool(self.tgls) or 0 < self.error < 1, "error must lie between 0 and 1")
        need(not self.tgls or self.gl_type in ("GQ", "GL", "PL"), "gl_type must be GQ, GL or PL")
        need(self.winsize > 1 or bool(self.winsize_multi) or (self.auto_winsize and self.weighted), "winsize must be above 1")
        need(self.max_gap >= 0, "max_gap must not be negative")
        need(0 <= self.overlap_frac <= 1, "overlap_frac must lie between 0 and 1")
        if 0 <= self.max_gap < 1000:
            w.append("max_gap is below 1000 base pairs")
        return e, w

    def check(self) -> list[str]:
        """Raises for errors, all in one message; gives the warnings."""
        errors, warnings = self.problems()
        if errors:
            raise ValueError("; ".join(errors))
        return warnings
