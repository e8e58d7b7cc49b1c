"""String parsing and normalisation as column expressions (no Python per row)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings that mean "no value" in genotype columns.
MISSING_MARKS = ["", "NA", "nan", "NaN", "N/A", "n/a"]

# Montage name prefixes per anatomical zone, in match order.
ZONE_PREFIXES = {
    "frontal": ["Fp", "AF", "F"],
    "central": ["FC", "C", "CP"],
    "parietal": ["P", "PO"],
    "occipital": ["O", "I"],
    "temporal": ["FT", "T", "TP"],
}


def _match(col: Column, pattern: str, group: int = 1) -> Column:
    """regexp_extract with NULL instead of '' when nothing matches."""
    return F.when(F.regexp_like(col, F.lit(pattern)), F.regexp_extract(col, pattern, group))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_extension(path: Column) -> Column:
    """All trailing suffixes ('.nii.gz'), NULL when there are none."""
    name = file_name(path)
    ext = F.regexp_extract(name, r"^\.*[^.]*(\..*)$", 1)
    return F.when((ext != "") & ~name.endswith("."), ext)


def name_entities(path: Column) -> Column:
    """map<string,string> of the key-value chunks of a file name; the last
    chunk with a key wins; an empty map when there are none."""
    name = file_name(path)
    stem = F.when(name.endswith("."), name).otherwise(F.regexp_extract(name, r"^(\.*[^.]*)", 1))
    pairs = F.transform(
        F.filter(F.split(stem, "_"), lambda c: c.contains("-")),
        lambda c: F.struct(F.lower(F.trim(F.regexp_extract(c, r"^([^-]*)-", 1))).alias("k"),
                           F.trim(F.regexp_extract(c, r"^[^-]*-(.*)$", 1)).alias("v")))
    pairs = F.filter(pairs, lambda p: (p.k != "") & (p.v != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(
        F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q.k == p.k))
    return F.map_from_entries(last)


def name_entity(path: Column, key: str) -> Column:
    """One entity of `name_entities` as a single pattern match, which is much
    cheaper per row than building the whole map."""
    name = file_name(path)
    stem = F.when(name.endswith("."), name).otherwise(F.regexp_extract(name, r"^(\.*[^.]*)", 1))
    return F.nullif(F.regexp_extract(stem, rf"(?i)^(?:.*_)?\s*{key}\s*-\s*([^_\s](?:[^_]*[^_\s])?)\s*(?:_.*)?$", 1), F.lit(""))


def name_suffix(path: Column) -> Column:
    """Final chunk without a '-' ('eeg', 'bold'); NULL otherwise."""
    name = file_name(path)
    stem = F.when(name.endswith("."), name).otherwise(F.regexp_extract(name, r"^(\.*[^.]*)", 1))
    tail = F.element_at(F.split(stem, "_"), -1)
    return F.when(~tail.contains("-"), tail)


def path_subject(path: Column) -> Column:
    head = F.element_at(F.split(path, "/"), 1)
    from_dir = F.when(path.contains("/") & head.startswith("sub-"), head)
    ent = name_entity(path, "sub")
    return F.coalesce(from_dir, F.concat(F.lit("sub-"), ent))


def path_modality(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when((F.size(parts) >= 3) & parts[1].isin("eeg", "anat", "func", "beh"), parts[1]).otherwise("root")


def subject_id(raw: Column) -> Column:
    """'7', '007' or 'P7x' -> 'sub-07'; 'sub-...' passes; no digits -> unchanged."""
    s = F.trim(raw.cast("string"))
    # digits stay text, so ids of any length keep their own subject
    digits = F.regexp_replace(F.regexp_extract(s, r"(\d+)", 1), r"^0+(?=\d)", "")
    minus = F.when(F.regexp_like(s, F.lit(r"^-\d+$")) & (digits != "0"), F.lit("-")).otherwise(F.lit(""))
    padded = F.when((F.length(digits) < 2) & (minus == ""), F.concat(F.lit("0"), digits)).otherwise(digits)
    return (F.when(s.startswith("sub-"), s)
            .when(F.regexp_like(s, F.lit(r"\d")), F.concat(F.lit("sub-"), minus, padded))
            .otherwise(s))


def allele_pair(raw: Column) -> Column:
    """struct<a1,a2,error> of a two-allele genotype string."""
    text = F.trim(raw.cast("string"))
    s = F.lower(text)
    forms = [r"^e([2-4])/e([2-4])$", r"^([2-4])/([2-4])$", r"^([2-4])([2-4])$",
             r"^0*([1-4])\s*[/_-]\s*0*([1-4])$", r"^0*([1-4]) 0*([1-4])$", r"^e([1-4])e([1-4])$"]
    a1 = F.coalesce(*[_match(s, p, 1) for p in forms]).cast("int")
    a2 = F.coalesce(*[_match(s, p, 2) for p in forms]).cast("int")
    error = (F.when(raw.isNull() | text.isin(MISSING_MARKS), F.lit("no first genotype"))
             .when(a1.isNull(), F.concat(F.lit("first genotype not understood: '"), raw.cast("string"), F.lit("'"))))
    return F.struct(a1.alias("a1"), a2.alias("a2"), error.alias("error"))


def snp_pair(raw: Column) -> Column:
    """struct<value,error>: order-free two-letter genotype over {A, G}. The
    plain form is case-free, the slashed form upper-case only."""
    s = F.trim(raw.cast("string"))
    plain = F.when(F.regexp_like(s, F.lit("^[AGag]{2}$")), F.upper(s))
    slashed = F.when(F.regexp_like(s, F.lit("^[AG]/[AG]$")), F.regexp_replace(s, "/", ""))
    letters = F.coalesce(plain, slashed)
    value = F.array_join(F.array_sort(F.split(letters, "")), "")
    error = (F.when(raw.isNull() | s.isin(MISSING_MARKS), F.lit("no second genotype"))
             .when(letters.isNull(), F.concat(F.lit("second genotype not understood: '"), raw.cast("string"), F.lit("'"))))
    return F.struct(value.alias("value"), error.alias("error"))


def carries(pair: Column, allele: int) -> Column:
    return (pair["a1"] == allele) | (pair["a2"] == allele)


def homozygous(pair: Column, allele: int) -> Column:
    return (pair["a1"] == allele) & (pair["a2"] == allele)


def derived_group(pair: Column, snp: Column) -> Column:
    """Class from the two genotypes; UNRESOLVABLE when no rule applies."""
    risk = snp["value"] == "GG"
    known = pair["error"].isNull() & snp["error"].isNull()
    return (F.when(known & homozygous(pair, 3) & ~risk, "N")
            .when(known & carries(pair, 4) & ~risk, "A_P_minus")
            .when(known & carries(pair, 4) & risk, "A_P_plus")
            .otherwise("UNRESOLVABLE"))


def target_framings(group: Column) -> Column:
    """array<struct<framing,class>> of the three target framings."""
    risk = F.when(group == "N", 0).when(group.isin("A_P_minus", "A_P_plus"), 1)
    high = F.when(group == "A_P_plus", 1).when(group.isin("N", "A_P_minus"), 0)
    multi = F.when(group == "N", 0).when(group == "A_P_minus", 1).when(group == "A_P_plus", 2)
    return F.array(*[F.struct(F.lit(n).alias("framing"), c.alias("class")) for n, c in
                     (("binary_risk_vs_none", risk), ("binary_high_vs_rest", high), ("multiclass_3", multi))])


def task_key(task: Column) -> Column:
    return F.regexp_replace(task, "^task-", "")


def to_float(v: Column, default: float = 0.0) -> Column:
    return F.coalesce(v.cast("string").try_cast("double"), F.lit(default))


def is_true(v: Column) -> Column:
    return F.coalesce(F.lower(F.trim(v.cast("string"))) == "true", F.lit(False))


def is_false(v: Column) -> Column:
    return F.coalesce(F.lower(F.trim(v.cast("string"))) == "false", F.lit(False))


def near_name(a: Column, b: Column, max_distance: int = 2) -> Column:
    return F.levenshtein(a, b) <= max_distance


def header_field(text: Column, field: str) -> Column:
    """Value of the first 'field=value' line, '' when absent."""
    return F.trim(F.regexp_extract(text, rf"(?m)^{field}=([^\r\n]+)", 1))


def header_channels(text: Column) -> Column:
    """Channel names of the 'ChN=name,...' lines, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^Ch\d+=([^,\r\n]*)"), 1)


def marker_code(description: Column) -> Column:
    """Integer code of a description ending in 'S <code>'; NULL otherwise."""
    return _match(description, r"S\s*(\d+)\s*$").cast("int")


def marker_label(description: Column) -> Column:
    return F.trim(F.element_at(F.split(description, "/"), -1))


def channel_zone(ch: Column) -> Column:
    """Anatomical zone of a channel name; the prefix must be the whole name or
    be followed by a digit or 'z'."""
    out = F.lit(None).cast("string")
    for zone, prefixes in reversed(list(ZONE_PREFIXES.items())):
        out = F.when(F.regexp_like(ch, F.lit("^(" + "|".join(prefixes) + ")([0-9zZ]|$)")), zone).otherwise(out)
    return out
