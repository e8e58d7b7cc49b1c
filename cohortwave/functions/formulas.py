"""Arithmetic formulas of the inventory as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the recording model.
NATIVE_CHANNELS = 127
DOCUMENTED_CHANNELS = 128
BYTES_PER_SAMPLE = 4
NATIVE_SFREQ_HZ = 1000
MAINS_HZ = 50.0
EPOCH_OVERLAP_FACTOR = 1.5
GB = 1024 ** 3


def duration_s(nbytes: Column, channels: int = NATIVE_CHANNELS, sfreq: float = NATIVE_SFREQ_HZ) -> Column:
    return nbytes / F.lit(float(channels * BYTES_PER_SAMPLE)) / F.lit(float(sfreq))


def derivative_bytes(duration: Column, channels: Column | int, sfreq: Column | float) -> Column:
    ch = channels if isinstance(channels, Column) else F.lit(float(channels))
    sf = sfreq if isinstance(sfreq, Column) else F.lit(float(sfreq))
    return duration * ch * sf * F.lit(float(BYTES_PER_SAMPLE))


def footprint(n: Column, channels: Column, duration: Column, sfreq: float) -> dict[str, Column]:
    """Preprocessed, epoched and decomposition sizes in GB, rounded to 2."""
    pre = n.cast("double") * derivative_bytes(duration, channels, sfreq)
    ep, ica = pre * F.lit(EPOCH_OVERLAP_FACTOR), pre
    gb = lambda c: F.round(c / F.lit(float(GB)), 2)
    return {"preprocessed_gb": gb(pre), "epoched_gb": gb(ep), "ica_gb": gb(ica), "total_gb": gb(pre + ep + ica)}


def harmonic_collision(freq: Column, width: float = 1.0, margin: float = 0.5) -> Column:
    hit = F.abs(F.lit(5.0) * freq - F.lit(MAINS_HZ)) < F.lit(width / 2 + margin)
    return F.coalesce((freq != 0) & hit, F.lit(False))


def nearest_harmonic(freq: Column, n_harmonics: int = 5) -> Column:
    """1-based index k with k*freq nearest to mains; the smaller k on a tie."""
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(n_harmonics)), lambda k: F.struct(
        F.abs(k * freq - F.lit(MAINS_HZ)).alias("d"), k.alias("k"))))
    return best["k"]


def auc_standard_error(auc: Column, n1: Column, n0: Column) -> Column:
    q1 = auc / (F.lit(2.0) - auc)
    q2 = F.lit(2.0) * auc * auc / (F.lit(1.0) + auc)
    var = (auc * (1 - auc) + (n1 - 1) * (q1 - auc * auc) + (n0 - 1) * (q2 - auc * auc)) / (n1 * n0)
    return F.sqrt(var)


def resolved(*candidates: tuple[str, Column], what: str) -> tuple[Column, Column]:
    """(value, source): the first non-NULL candidate and its name; evaluating
    the value raises when every candidate is NULL."""
    value = F.coalesce(*[c for _, c in candidates], F.raise_error(F.lit(f"cannot resolve {what}")).cast("double"))
    source = F.lit(None).cast("string")
    for name, c in reversed(candidates):
        source = F.when(c.isNotNull(), name).otherwise(source)
    return value, source


def rule_flags(*rules: Column) -> Column:
    """';'-joined text of the rules that fired, in the declared order."""
    return F.array_join(F.array_compact(F.array(*rules)), ";")
