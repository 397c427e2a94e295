"""Strings of metadata: cleaning, keys, paths and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Audio suffixes of each stage.
AUDIO_SUFFIXES = {
    "all": ("wav", "mp3", "flac", "ogg", "m4a", "aac"),
    "harvest": ("mp3",),
    "metadata": ("wav", "mp3", "flac", "ogg"),
    "segment": ("wav", "mp3", "flac", "ogg", "aiff"),
    "augment": ("wav",),
}


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def cleaned(text: Column, missing: str | None = None) -> Column:
    out = F.lower(stripped(text))
    return out if missing is None else F.coalesce(out, F.lit(missing))


def composite(*parts: Column) -> Column:
    """Joined by underscores, spaces replaced; null if any part is."""
    spaced = [F.replace(p, F.lit(" "), F.lit("_")) for p in parts]
    out = spaced[0]
    for p in spaced[1:]:
        out = F.concat(out, F.lit("_"), p)
    return out


def composite_text(*parts: Column) -> Column:
    """Joined by underscores, null as the word None."""
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Lower-case suffix without the dot, empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r".\.([^.]*)$", 1))


def parent(path: Column) -> Column:
    """Name of the folder that holds the file, null at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2))


def base_id(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def recording_id(name: Column) -> Column:
    """Without leading X and C characters, as many as there are."""
    return F.ltrim(name, F.lit("XC"))


def with_suffix(path: Column, new: str) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", f".{new}")


def relative(path: Column, base: str) -> Column:
    return F.when(F.startswith(path, F.lit(base.rstrip("/") + "/")), F.substring(path, len(base.rstrip("/")) + 2, 1 << 30)).otherwise(path)


def is_audio(path: Column, stage: str = "all") -> Column:
    return suffix(path).isin(*AUDIO_SUFFIXES[stage])


def none_as_null(option: Column) -> Column:
    """The word none, in any case, means that an option is off."""
    return F.when(F.lower(option) != "none", option)


def combo_code(pre: Column, denoise: Column, segment: Column, augment: Column) -> Column:
    """Short code of a combination: first letters of its options."""
    short = lambda c: F.upper(F.substring(F.coalesce(c.cast("string"), F.lit("none")), 1, 3))
    return F.concat(F.lit("PE"), F.coalesce(pre.cast("string"), F.lit("none")), F.lit("-D"), short(denoise), F.lit("-S"), short(segment), F.lit("-A"), short(augment))


def template(text: Column, name: str, value: str) -> Column:
    return F.replace(text, F.lit("${" + name + "}"), F.lit(value))


#: Fixed format: the name of a combination of options.
COMBO_TAG = "%s_%s_%sHz_%sbit_%s_D%s__PE%s_Amp%s_S%s_Aug%s"
COMBO_FIELDS = (
    "subset", "format", "sampling_rate", "bit_depth", "channels", "denoising", "pre_emphasis", "amplitude_method", "segmentation", "augmentation",
)


def combo_tag() -> Column:
    return F.format_string(COMBO_TAG, *[F.col(c).cast("string") for c in COMBO_FIELDS])
