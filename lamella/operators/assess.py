"""Quality facts and remarks, fused quality, and defaults of a reconstruction, as columns over series headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, fmt

#: fixed values: transfer syntaxes that lose detail
LOSSY = ("1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.4.51", "1.2.840.10008.1.2.4.81", "1.2.840.10008.1.2.4.91", "1.2.840.10008.1.2.4.203")
#: fixed values: makers of cone-beam devices
CBCT = "planmeca|carestream|kodak|sirona|dentsply|vatech|imaging sciences|i-?cat|newtom|qr srl|kavo|morita|gendex|soredex|instrumentarium|myray|cefla|prexion|acteon|owandy|hdx|genoray|ray co"
#: fixed values: modalities that are expected
EXPECTED = "^(CT|CBCT|DX|CR|PX|IO)$"


def is_lossy(syntax: Column) -> Column:
    return syntax.isin(*LOSSY)


def is_cbct(maker: Column) -> Column:
    return F.coalesce(maker, F.lit("")).rlike(f"(?i){CBCT}")


def level(score: Column) -> Column:
    return F.when(score >= 75, "good").when(score >= 45, "moderate").otherwise("limited")


def facts(nx: Column, ny: Column, nz: Column, sx: Column, sy: Column, sz: Column) -> Column:
    """array<struct<label, value>> of a volume."""
    pairs = [
        ("Slices", nz.cast("string")), ("Matrix", F.concat_ws(" x ", nx.cast("string"), ny.cast("string"))), ("Pixel", F.concat(fmt(sx, 3), F.lit(" x "), fmt(sy, 3), F.lit(" mm"))),
        ("Between slices", F.concat(fmt(sz), F.lit(" mm"))), ("Anisotropy", F.concat(fmt(sz / F.least(sx, sy), 1), F.lit("x"))), ("Coverage", F.concat(fmt((nz - 1) * sz, 0), F.lit(" mm"))),
    ]
    return F.array(*(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in pairs))


def listed(pairs: Column) -> Column:
    return F.concat_ws("; ", F.transform(pairs, lambda p: F.concat_ws(": ", p["label"], p["value"])))


def remarks(duplicates: Column, oblique: Column, maker: Column, multi_frame: Column, modality: Column) -> Column:
    """array<string> of what does not count against a volume: null remarks are left out."""
    return F.array_compact(
        F.array(
            F.when(duplicates > 0, F.concat(duplicates.cast("string"), F.lit(" duplicate slice(s) ignored"))),
            F.when(oblique > 2, F.concat(F.lit("slices tilted by "), fmt(oblique, 1), F.lit(" degrees"))),
            F.when(is_cbct(maker), "cone beam: densities are not calibrated"),
            F.when(multi_frame, "multi-frame: places estimated from the header"),
            F.when((modality != "") & ~modality.rlike(f"(?i){EXPECTED}"), F.concat(F.lit("modality "), modality, F.lit(" is not expected"))),
        )
    )


def fused(effective: DataFrame, warnings: DataFrame | None = None, grid: float = 0.5) -> DataFrame:
    """(study, score, level, facts, warnings) of fused volumes, by their effective gap.

    ``warnings`` (study, warnings: array<string>) of the main series are kept but for those on its slices' spacing and number.
    """
    score = F.when(F.col("gap") <= 1.25, 80).when(F.col("gap") <= 4, 60).otherwise(40)
    told = F.array(F.concat(F.lit("fused from "), F.col("n_used").cast("string"), F.lit(" series; about "), fmt(F.col("gap"), 1), F.lit(" mm between real slices")))
    best = F.concat(F.concat_ws(" / ", *(fmt(F.col(c), 1) for c in ("ex", "ey", "ez"))), F.lit(" mm"))
    pairs = F.array(
        *(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in (("Series fused", F.col("n_used").cast("string")), ("Grid", F.concat(fmt(F.lit(grid)), F.lit(" mm"))), ("Effective spacing", F.concat(fmt(F.col("gap"), 1), F.lit(" mm"))), ("Best axes", best)))
    )
    d = effective.where("strategy = 'fusion'")
    if warnings is not None:
        d = d.join(warnings, "study", "left")
        told = F.concat(told, F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: ~w.rlike("slices$")))
    return d.select("study", score.alias("score"), level(score).alias("level"), pairs.alias("facts"), told.alias("warnings"))


def defaults(suggested: Column, contrast: Column, cbct: Column, fused_: Column, sx: Column, sz: Column) -> dict[str, Column]:
    """Threshold with its range, smoothing, interpolation and target spacing that a volume starts with."""
    t = F.when(contrast & ~cbct, F.greatest(F.lit(350), suggested)).otherwise(suggested)
    smooth = F.when(fused_, 0.7).when(sz > 3, 0.8).when(sz > 1.25, 0.5).otherwise(0.3)
    target = F.when(sz <= 1, sz).otherwise(F.greatest(clamp(sx * 2, 0.5, 1.0), F.least(F.lit(1.6), sz / 3.5)))
    return {"threshold": t, "lowest": F.least(F.lit(-200), t - 500), "highest": F.greatest(F.lit(1500), t + 1500), "smoothing": smooth, "interpolation": F.when(sz > 2, "shape").otherwise("cubic"), "target": target}


def tissue_note(contrast: Column, cbct: Column) -> Column:
    first = F.when(contrast, "With contrast: enhanced vessels show in red.").otherwise("No contrast found: vessels and muscles have the same density.")
    return F.concat_ws(" ", first, F.lit("Nerves do not show in a CT; trace the canal in the panoramic view."), F.when(cbct, "Cone beam: ranges of soft tissue are not reliable."))
