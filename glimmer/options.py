"""Options of an extraction, by name; a name may be shortened as long as it stays unambiguous."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


# The defaults of an extraction.
@dataclass(frozen=True)
class Options:
    ssub: int = 1
    tsub: int = 1
    min_corr: float = 0.3
    min_pnr: float = 10.0
    gSig: float = 5.0
    gSiz: int | None = None
    bd: int = 3
    min_pixel: int = 5
    ring_radius: int = 15
    num_neighbors: int | None = None
    background_model: str = "svd"
    nb: int = 1
    bg_ssub: int = 1
    merge_thr: float = 0.85
    dmin: float = 1.0
    smin: float = 5.0
    nrgthr: float = 0.99
    maxIter: int = 5
    df_prctile: float = 50.0
    nsd: float = 3.0
    nfr: int = 5
    patch: int = 64
    seeds_per_patch: int | None = None


# End of fixed values.


def updated(options: Options, *pairs, **named) -> Options:
    """options with name, value, name, value, ... changed. Unknown or ambiguous names are errors, case does not matter."""
    if len(pairs) % 2:
        raise ValueError("names and values must come in pairs")
    names = [f.name for f in fields(options)]
    found = {}
    for name, value in [*zip(pairs[::2], pairs[1::2], strict=True), *named.items()]:
        exact = [n for n in names if n.lower() == name.lower()]
        fit = exact or [n for n in names if n.lower().startswith(name.lower())]
        if len(fit) != 1:
            raise ValueError(f"{name}: {'ambiguous' if fit else 'unknown'} option")
        found[fit[0]] = value
    return replace(options, **found)
