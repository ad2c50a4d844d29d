"""Listings: label names, label values, mapping files."""

from pyspark.sql import DataFrame, functions as F

from stackloom.operators.select import ProfileType, in_open_range, in_range, label, matching, select_type


def _names(samples: DataFrame) -> DataFrame:
    used = F.map_keys(F.map_filter("labels", lambda _, v: v.isNotNull()))
    return samples.select(F.explode(used).alias("label")).distinct().orderBy("label")


def label_names(samples: DataFrame, profile_type: ProfileType | None = None, match=(), start: int = 0,
                end: int = 0) -> DataFrame:
    """Names of labels in use, sorted; matchers only count together with a profile type."""
    samples = in_open_range(samples, start, end)
    if profile_type is not None:
        samples = matching(select_type(samples, profile_type), match)
    return _names(samples)


def label_values(samples: DataFrame, name: str, profile_type: ProfileType | None = None, start: int = 0,
                 end: int = 0) -> DataFrame:
    """Non-empty values of one label, sorted."""
    samples = in_open_range(samples, start, end)
    if profile_type is not None:
        samples = select_type(samples, profile_type)
    values = samples.select(label(name).alias("value")).where("value <> ''")
    return values.distinct().orderBy("value")


def mapping_files(samples: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Binaries that occur in a selection, sorted."""
    samples = in_range(samples, start, end)
    # distinct inside each stack first, so few rows leave the explode
    files = F.array_distinct(F.transform("stacktrace", lambda loc: loc["mapping_file"]))
    return (samples.select(F.explode(files).alias("mapping_file")).where("mapping_file is not null")
            .distinct().orderBy("mapping_file"))


def metadata_labels(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Label names within an inclusive range."""
    return _names(in_range(samples, start, end))


def profile_metadata(samples: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Mapping files and label names of a selection."""
    return mapping_files(samples, start, end), metadata_labels(samples, start, end)
