"""Default parameters of the operators, typed; units are metres, square metres and degrees."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Segmentation:
    planarity: float = 0.3
    degrees: float = 5.0
    relative: float = 0.025
    neighbours: int = 8


@dataclass(frozen=True)
class Evaluation:
    """``gates``: several shares of inliers to judge the same planes by, in place of ``gate``."""

    thresholds: tuple[float, ...] = (0.001, 0.005, 0.01)
    iterations: int = 200
    support: int = 100
    gate: float = 0.9
    seed: int = 0
    gates: tuple[float, ...] = ()

    @property
    def judged(self) -> list[float]:
        return list(self.gates) or [self.gate]


@dataclass(frozen=True)
class Extraction:
    """Growth, sweep, acceptance, merge and saturation of mesh planes."""

    grow_degrees: float = 8.0
    grow_distance: float = 0.015
    dihedral: float = 55.0
    refit_every: int = 15
    sweep_degrees: float = 9.0
    sweep_distance: float = 0.012
    sweep_share: float = 1.0
    least_faces: int = 60
    least_area: float = 0.10
    merge_degrees: float = 10.0
    merge_distance: float = 0.02
    rounds: int = 2


@dataclass(frozen=True)
class Outdoor:
    iterations: int = 500
    distance: float = 0.01
    cosine: float = 0.985
    least_pixels: int = 50
    most_planes: int = 50
    merge_absolute: float = 0.1
    merge_relative: float = 0.02


def scaled(p: Extraction, mode: str, metres_per_unit: float | None, base: float = 1.0) -> Extraction:
    """Parameters in a scene's own unit: distances times S and areas times S squared. ``off``, or no known unit, leaves them."""
    if mode == "off" or (mode == "original" and metres_per_unit is None):
        return p
    s = (base if mode == "original" else 1.0) / (metres_per_unit or 1.0)
    factor = {n.name: s * s if n.name.endswith("area") else s for n in fields(p) if n.name.endswith(("distance", "area"))}
    return replace(p, **{n: getattr(p, n) * k for n, k in factor.items()})


def cast(kind: type, values: dict[str, str]):
    """A parameter set from text values; unknown names are an error."""
    own = {n.name: type(getattr(kind(), n.name)) for n in fields(kind)}
    if unknown := set(values) - set(own):
        raise KeyError(f"unknown parameters: {sorted(unknown)}")
    return kind(**{k: tuple(float(x) for x in v.split(",")) if own[k] is tuple else own[k](v) for k, v in values.items()})


@dataclass(frozen=True)
class Quality:
    """The six gates that a plane over faces must pass; ``inlier_distance`` says what counts as an inlier."""

    p95: float = 0.03
    inlier_frac: float = 0.8
    inlier_distance: float = 0.012
    thickness: float = 0.0192
    degrees: float = 8.0
    width: float = 0.06
    fill: float = 0.18


@dataclass(frozen=True)
class LabelPass:
    """Growth, sweeps and merges of one label's planes; ``em_growth``: share of new faces below which a region is done.

    ``consensus``: neighbours that a swept face needs; ``clusters``: keep of a swept region only the run of offsets with most of its
    seed faces; ``offset_gap`` parts the runs, by default half the sweep's distance, 1 cm at least.
    """

    growth: Extraction = Extraction()
    quality: Quality = Quality()
    em_rounds: int = 4
    em_growth: float = 0.005
    consensus: int = 2
    clusters: bool = True
    offset_gap: float | None = None
    saturation: Quality = Quality(inlier_distance=0.02, thickness=0.04, degrees=10.0, width=0.05, fill=0.15)
    saturation_degrees: float = 12.0
    saturation_distance: float = 0.02
    saturation_share: float = 0.66
    saturation_rounds: int = 2

    @property
    def gap(self) -> float:
        return self.offset_gap if self.offset_gap is not None else max(0.010, 0.5 * self.growth.sweep_distance)


@dataclass(frozen=True)
class Tiers:
    """Areas that part small, normal, big and huge faces, and the search for planes over the big ones."""

    small: float = 0.02
    normal: float = 10.0
    big: float = 60.0
    quality: Quality = Quality(p95=0.05, inlier_frac=0.5, inlier_distance=0.01, thickness=0.036, degrees=12.0, width=0.03, fill=0.02)
    distance: float = 0.01
    degrees: float = 10.0
    iterations: int = 300
    least_faces: int = 1
    least_area: float = 0.02
    least_share: float = 0.5
    most: int = 16
    merge_degrees: float = 8.0
    merge_distance: float = 0.015
    seed: int = 123


@dataclass(frozen=True)
class Leftovers:
    """The search for planes over what no plane has: RANSAC over each connected rest, ``most`` planes of it at most."""

    distance: float = 0.012
    degrees: float = 12.0
    iterations: int = 400
    least_faces: int = 30
    least_area: float = 1.0
    least_share: float = 0.1
    most: int = 8
    seed: int = 987


@dataclass(frozen=True)
class Relaxed:
    """The last growth: gates, the share of a plane's area up to which free faces join it, and how much larger a plane must be to take another's."""

    distance: float = 0.02
    degrees: float = 18.0
    free_share: float = 1.0
    steal_factor: float = 5.0


@dataclass(frozen=True)
class Split:
    """When a label's faces are cut in two: vertices and faces of a part, and parts of a label."""

    vertices: int = 700_000
    faces: int = 50_000
    parts: int = 8
    mode: str = "axis"
