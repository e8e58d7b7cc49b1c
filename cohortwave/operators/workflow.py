"""The stages put together: listing to cohort, raw blocks to clean blocks with
their QC facts, clean blocks to feature tables. Each returns DataFrames; what
is read more than once is written to the scratch folder in between."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import aggregates as ag, cohort as co, cycles as cy, quality as dq, signal as sg, spectral as sp


def audit(listing: DataFrame, participants: DataFrame, client: DataFrame, roles: dict[str, str], tasks: list[str], groups: list[str]) -> dict[str, DataFrame]:
    """Listing, participants and client list -> reconciliation, cohort,
    inventory, effective N and missingness."""
    co.resolve_roles(participants, roles)
    files = cut_lineage(co.require_tasks(co.parse_listing(listing)), "listing")
    rec = cut_lineage(co.reconcile(participants, client, roles["subject_id"], roles["apoe"], roles["picalm"]), "reconciled")
    present = rec.where("status <> 'MISSING_FROM_TSV'").select("subject")
    eeg = files.where("modality = 'eeg'")
    cohort = cut_lineage(co.cohort_flags(present, client.select("subject"), eeg.select("subject")), "cohort")
    kept = eeg.join(cohort.where("final_include").select("subject"), "subject", "left_semi").join(client, "subject")
    inv = cut_lineage(ag.inventory(kept, tasks, ["grp"]), "inventory")
    return {"listing": files, "reconciliation": rec, "gate": co.stop_gate(rec), "cohort": cohort, "inventory": inv,
            "effective_n": ag.effective_n(inv, tasks, groups), "missingness": ag.missingness_by_group(inv, tasks),
            "missing_subjects": ag.missing_subjects(inv, tasks)}


def preprocess(blocks: DataFrame, positions: DataFrame, rec: list[str], channel: str, block_len: int, sfreq: float, target: float,
               mains: float = 50.0, notch_width: float = 1.0, high_pass: float = 0.5, occipital: list = (), order: str = "post_interpolation",
               peak: float = 1.5e-4) -> dict[str, DataFrame]:
    """High-pass, bad channels, repair and average reference, anti-alias and
    decimate, notch; with bad-channel counts, line-noise index before and after
    and the artifact fraction."""
    keys = [*rec, channel]
    hp = cut_lineage(sg.fir_filter(blocks, keys, sg.fir_taps(sfreq, high_pass, None)), "highpass")
    nb = cut_lineage(co.nearest_sensors(positions, rec), "neighbours")
    flags = cut_lineage(sg.bad_channels(hp, nb, rec, channel), "flags")
    ref = cut_lineage(sg.reference_and_repair(hp, flags, nb, rec, channel, order), "referenced")
    low = cut_lineage(sg.resample(ref, keys, block_len, sfreq, target), "resampled")
    ratio = int(sfreq / target)
    blen = block_len // ratio
    clean = cut_lineage(sg.notch(low, keys, target, mains, notch_width), "clean")
    seg = int(target * 4)

    def noise(d):
        psd = sp.welch(d, keys, blen, target, seg, 0.5, mains - 6, mains + 6).groupBy(*rec, "f").agg(F.avg("p").alias("p"))
        return sp.line_noise_index(psd, rec, mains, 0.5, ((mains - 6, mains - 4), (mains + 4, mains + 6)))

    facts = (sg.bad_channel_counts(flags, rec, channel, list(occipital))
             .join(noise(low).withColumnRenamed("line_noise_index", "line_before"), rec, "left")
             .join(noise(clean).withColumnRenamed("line_noise_index", "line_after"), rec, "left")
             .join(sg.artifact_fraction(clean, rec, channel, blen, int(target), peak), rec, "left"))
    return {"blocks": clean, "bad_channels": flags, "qc_facts": facts}


def cycle_feature_tables(blocks: DataFrame, rec: list[str], channel: str, block_len: int, sfreq: float, iaf_hz: float, n_sub: int = 200,
                         blocks_per_chunk: int = 50, half_width: float = 2.0, min_period: int = 40) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean blocks -> (18 waveform features per recording, status with reasons,
    cycle statistics per channel). Recordings are grouped by their peak
    frequency beforehand: one call serves one narrow band."""
    keys = [*rec, channel]
    nb = sg.fir_filter(blocks, keys, sg.fir_taps(sfreq, max(0.1, iaf_hz - half_width), iaf_hz + half_width))
    c = cy.phase_locked_cycles(cy.crossings(nb, keys, block_len), keys, blocks_per_chunk)
    w = cut_lineage(cy.cut_waves(c, blocks, keys, block_len), "waves")
    v = cut_lineage(cy.valid_cycles(w, keys, sfreq, F.lit(iaf_hz)), "valid")
    st = cut_lineage(cy.cycle_stats(v, keys), "stats")
    enough = st.where(F.col("n_valid") >= n_sub).select(*keys)
    f = cut_lineage(cy.cycle_features(cy.psr(v.join(enough, keys, "left_semi"), keys, min_period), st, keys), "features")
    feats, status = cy.subject_features(f, st, rec, channel, n_sub)
    return dq.check_label_blind(feats), status, st
