"""Text, code and parser expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import constants as C
from cohortlens.session import stage

# Fixed value: the code points Python's str.split() treats as white space.
WHITE = (
    "[\\x09-\\x0d\\x1c-\\x20\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
)


def squeeze(value: Column) -> Column:
    """Trim and collapse white space to single spaces."""
    return F.trim(F.regexp_replace(value, f"{WHITE}+", " "))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, f"\\A{WHITE}+|{WHITE}+\\z", "")


def is_blank(value: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(strip(value) == "", F.lit(True))


@F.arrow_udf(T.StringType())
def _fold_unicode(values: pa.Array) -> pa.Array:
    """Folded text; a batch without any text, as ASCII labels give, is passed on untouched."""
    if values.null_count == len(values):
        return values

    def fold(text):
        return None if text is None else " ".join(unicodedata.normalize("NFKC", text).split()).casefold()

    # Labels repeat; each distinct one of a batch is folded once.
    coded = values.dictionary_encode()
    return pa.array([fold(v) for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def normalize_ascii(value: Column) -> Column:
    """The normalization rule for text known to be ASCII; stays inside the JVM."""
    return F.lower(squeeze(value))


def normalize_jvm(value: Column) -> Column:
    """`normalize_identity` of labels that a `normalizer` has found to be ASCII."""
    return F.nullif(normalize_ascii(value), F.lit(""))


def normalizer(labels: DataFrame) -> Callable[[Column], Column]:
    """The rule to use for labels that are made of the columns of ``labels`` and ASCII text.

    One aggregate looks at every label. If none has a character beyond ASCII the rule stays in the JVM, where it gives
    the same, and no task starts Python; otherwise it is `normalize_identity`.
    """
    odd = F.lit(False)
    for name in labels.columns:
        odd = odd | ~F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).rlike("\\A[\\x00-\\x7f]*\\z")
    return normalize_identity if labels.agg(F.bool_or(odd).alias("odd")).first()["odd"] else normalize_jvm


def normalize_identity(value: Column) -> Column:
    """NFKC, collapsed white space, case folding; blank text becomes null.

    ASCII text takes the JVM path. Only other text is handed to the Arrow function;
    ASCII rows pass it a null.
    """
    ascii_only = value.rlike("\\A[\\x00-\\x7f]*\\z")
    folded = F.when(ascii_only, normalize_ascii(value)).otherwise(
        _fold_unicode(F.when(~ascii_only, value))
    )
    return F.nullif(folded, F.lit(""))


def normalize_by_dictionary(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add normalized columns through a table of distinct labels.

    The Arrow function then runs once per distinct label instead of once per row. The
    dictionary is staged, so Catalyst sees its true size and picks the join from that.
    """
    source = list(columns)
    labels = df.select(F.explode(F.array_compact(F.array(*source))).alias("label")).distinct()
    lookup = stage(labels.select("label", normalize_identity(F.col("label")).alias("folded")), "labels")
    out = df
    for name, target in columns.items():
        side = lookup.select(F.col("label").alias(f"_{name}"), F.col("folded").alias(target))
        out = out.join(side, F.col(name) == F.col(f"_{name}"), "left").drop(f"_{name}")
    return out


def normalize_alias(value: Column) -> Column:
    """Identity normalization with hyphens and underscores read as spaces."""
    return squeeze(F.regexp_replace(normalize_identity(value), "[-_]", " "))


def lookup(value: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, null when the key is absent."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def transmission(value: Column) -> Column:
    return lookup(normalize_alias(value), C.TRANSMISSION_ALIASES)


def drivetrain(value: Column) -> Column:
    return lookup(normalize_alias(value), C.DRIVETRAIN_ALIASES)


def _family(text: Column) -> Column:
    chain = F.when(text.isNull() | (text == ""), "unknown")
    for family, roots in C.COMPONENT_ROOTS:
        hit = F.lit(False)
        for root in roots:
            hit = hit | (text == root) | text.startswith(f"{root}:") | text.startswith(f"{root},")
        chain = chain.when(hit, family)
    return chain.otherwise("other")


def component(value: Column) -> Column:
    """Component family by exact root, or root followed by ``:`` or ``,``."""
    return F.element_at(families(F.array(value)), 1)


def families(values: Column) -> Column:
    """Component family of every label in an array.

    The label is prepared in its own step, once, not once per compared root.
    """
    return F.transform(F.transform(values, lambda v: F.upper(strip(v))), _family)


def component_of_roots(roots: Column) -> Column:
    """Distinct sorted component families of an array of source labels."""
    return F.array_sort(F.array_distinct(families(roots)))


def component_bits(df: DataFrame, label: str, name: str) -> DataFrame:
    """Add ``name``: the bit of the label's component family, zero where the label is null.

    Families are told from distinct labels, which are staged, so Catalyst sees their true size and picks the join from
    that. ``bit_or`` of the column is the set of families of a group in one number.
    """
    families_ = {family: 1 << i for i, family in enumerate(C.COMPONENTS)}
    labels = df.select(F.col(label).alias("_label")).where(F.col("_label").isNotNull()).distinct()
    bits = labels.select("_label", lookup(component(F.col("_label")), families_).cast("bigint").alias(name))
    joined = df.join(stage(bits, "component-bits"), F.col(label) == F.col("_label"), "left").drop("_label")
    return joined.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def has_component(bits: Column, family: str) -> Column:
    """Whether a number made of ``component_bits`` holds a family."""
    return bits.bitwiseAND(F.lit(1 << C.COMPONENTS.index(family)).cast("bigint")) != 0


def recall_type(code: Column) -> Column:
    return F.coalesce(lookup(code, C.RECALL_TYPE_CODES), F.lit("OTHER"))


def communication_type(name: Column) -> Column:
    return F.coalesce(lookup(name, C.COMMUNICATION_TYPE_NAMES), F.lit("UNKNOWN"))


def severity(deaths: Column, injuries: Column, crash: Column, fire: Column) -> Column:
    """Strongest observed evidence; ``low`` needs all four observed and clear."""
    clear = (deaths == 0) & (injuries == 0) & ~crash & ~fire
    return (
        F.when(deaths > 0, "critical")
        .when(injuries > 0, "high")
        .when(crash | fire, "moderate")
        .when(clear, "low")
        .otherwise("unknown")
    )


def has_control_character(value: Column) -> Column:
    """True when the text holds a code point U+0080 to U+009F."""
    return F.coalesce(value.rlike("[\\u0080-\\u009f]"), F.lit(False))


# --- parsers: a value that does not match the pattern never reaches the cast ------


def matches(value: Column, pattern: str) -> Column:
    return value.rlike(f"\\A(?:{pattern})\\z")


def unsigned(value: Column) -> Column:
    """A whole number of digits only; null for other text and beyond 64 bits."""
    return F.when(matches(value, "[0-9]+"), value.try_cast("bigint"))


def yes_no(value: Column) -> Column:
    return F.when(value == "Y", True).when(value == "N", False)


def compact_date(value: Column) -> Column:
    """``YYYYMMDD`` to a date; null for any other text or an impossible day.

    ``value`` stands in it once, so that what makes it is not computed again. Text of another form becomes dashes alone.
    """
    dashed = F.regexp_replace(value, "(?s)\\A(?!0000)([0-9]{4})([0-9]{2})([0-9]{2})\\z|.+", "$1-$2-$3")
    return dashed.try_cast("date")


def model_year(value: Column) -> Column:
    """Four digits, not 9999, within the supported range; otherwise null."""
    year = F.when(matches(value, "[0-9]{4}") & (value != "9999"), value.try_cast("int"))
    return F.when(year.between(C.MIN_MODEL_YEAR, C.MAX_MODEL_YEAR), year)


def flagged_date(value: Column, name: str) -> tuple[Column, Column]:
    """Date within 1900 to 2100 and, when it is unusable, the flag saying why."""
    day = compact_date(value)
    usable = F.year(day).between(1900, 2100)
    flag = (
        F.when(~matches(value, "[0-9]{8}"), f"malformed_{name}")
        .when(day.isNull(), f"invalid_{name}")
        .when(~usable, f"out_of_range_{name}")
    )
    return F.when(usable, day), flag


def split_years(value: Column) -> Column:
    return F.split(value, ",")


def period_label(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("Q"), quarter.cast("string"))


def any_period_by(periods: Column, year: int) -> Column:
    """True when one of the ``YYYYQn`` labels lies in ``year`` or before."""
    return F.coalesce(F.exists(periods, lambda p: F.substring(p, 1, 4).cast("int") <= year), F.lit(False))
