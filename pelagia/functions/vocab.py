"""Oceanographic vocabularies: code rules as Column functions, and lookups in loadable tables.

The code lists themselves are data of their publishers; a Vocabulary is loaded from a CSV (first column the key,
trimmed; empty values skipped; a later row wins) and used as a literal map while small, by a join beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.operators.joins import first_match

#: Up to so many codes become a literal map in the plan.
LITERAL = 2000


class Vocabulary:
    def __init__(self, table: DataFrame):
        """table: key string, value string, one row a key."""
        self.table = table
        rows = table.limit(LITERAL + 1).collect()
        self.small = {r[0]: r[1] for r in rows} if len(rows) <= LITERAL else None

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, value: str | int = 1) -> Vocabulary:
        df = spark.read.csv(path, header=True)
        name = value if isinstance(value, str) else df.columns[value]
        df = df.select(F.trim(F.col(f"`{df.columns[0]}`")).alias("key"), F.trim(F.col(f"`{name}`")).alias("value"), F.monotonically_increasing_id().alias("n"))
        df = df.filter("value IS NOT NULL AND value != ''")
        last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n")))
        return cls(df.withColumn("r", last).filter("r = 1").select("key", "value"))

    @classmethod
    def of(cls, spark: SparkSession, codes: dict[str, str]) -> Vocabulary:
        return cls(spark.createDataFrame(list(codes.items()), "key string, value string"))

    def map(self, code: Column) -> Column:
        """The value of a code, null if unknown; small vocabularies only."""
        if self.small is None:
            raise ValueError("the vocabulary is too large for a literal map; use lookup()")
        if not self.small:
            return F.lit(None).cast("string")
        cells = [F.lit(x) for kv in self.small.items() for x in kv]
        return F.try_element_at(F.create_map(*cells), code)

    def lookup(self, df: DataFrame, code: str, out: str) -> DataFrame:
        """df with column `out`, by a join whose strategy Spark picks."""
        if self.small is not None:
            return df.withColumn(out, self.map(F.col(code)))
        t = self.table.select(F.col("key").alias("__key"), F.col("value").alias(out))
        return df.join(t, F.col(code) == F.col("__key"), "left").drop("__key")


#: Lookups whose values are numbers.
NUMBERS = ("map_wod_edmo", "map_wod_edmo_approx", "map_argo_platform_edmo")
#: The vocabularies that a catalog can hold, by function name.
LOOKUPS = (
    "map_c17", "map_c17_l06", "map_l22_l05", "map_wmo_instrument_type_l05", "map_wmo_instrument_type_l22", "map_cora_instrument_l05",
    "map_cora_instrument_l22", "map_argo_platform_edmo", "map_wod_instrument_l05", "map_wod_instrument_l22",
    "map_wod_instrument_l33", "map_wod_platform_c17", "map_wod_edmo", "map_wod_edmo_approx", "map_platform_c17_l06",
)


def _cases(code: Column, table: dict[str, str], prefix: str) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(code == k, F.lit(prefix + v)).otherwise(out)
    return out


# The codes that the public L05 and L06 vocabularies give to each two-letter data source.
_L05 = {
    "BO": "30",
    "CT": "130",
    "ML": "134",
    "SF": "131",
    "TS": "133",
    "TX": "135",
    "XB": "132",
}
_L06 = {
    "BO": "30",
    "CT": "30",
    "DB": "42",
    "FB": "35",
    "GL": "27",
    "ML": "36",
    "MO": "48",
    "PF": "46",
    "SD": "3B",
    "SF": "23",
    "SM": "70",
    "TS": "30",
    "TX": "48",
    "XB": "30",
    "XX": "0",
}


def map_cmems_bigram_l05(bigram: Column) -> Column:
    return _cases(bigram, _L05, "SDN:L05::")


def map_cmems_bigram_l06(bigram: Column, wmo: Column) -> Column:
    """The bigram's platform, but a CT of WMO type 995 is an animal."""
    return F.when((bigram == "CT") & (F.coalesce(wmo, F.lit("")) == "995"), F.lit("SDN:L06::70")).otherwise(_cases(bigram, _L06, "SDN:L06::"))


def map_cora_platform_l06(bigram: Column, wmo: Column) -> Column:
    del wmo
    return _cases(bigram, _L06, "SDN:L06::")


def code_in_brackets(s: Column, vocabulary: str, last: bool = False) -> Column:
    """`text (130)` as `SDN:L05::130`: the first bracket (the last one, if asked), null without one."""
    pattern = r"(?s).*\(([^)]*)\)" if last else r"\(([^)]*)\)"
    found = F.regexp_extract(s, pattern, 1)
    return F.when(s.rlike(r"(?s)\([^)]*\)"), F.concat(F.lit(vocabulary), found))


def map_instrument_l05(s: Column) -> Column:
    return code_in_brackets(s, "SDN:L05::")


def map_platform_l06(s: Column) -> Column:
    return code_in_brackets(s, "SDN:L06::")


def map_originator_edmo(s: Column) -> Column:
    return code_in_brackets(s, "", last=True).try_cast("bigint")


def map_instrument_l05_multi(s: Column) -> Column:
    """All bracketed codes, joined by one space."""
    return F.concat_ws(" ", F.transform(F.regexp_extract_all(s, F.lit(r"\(([^)]*)\)"), 1), lambda x: F.concat(F.lit("SDN:L05::"), x)))


def map_instrument_info_l22(s: Column, p01: Column) -> Column:
    """In entries `.. SDN:P01::x .. SDN:L22::y` separated by |, the L22 code of the entry with this P01 code (the last one)."""
    entries = F.filter(F.split(s, r"\|"), lambda e: F.regexp_extract(e, r"(SDN:P01::\S+)", 1) == p01)
    code = F.regexp_extract(F.element_at(entries, -1), r"(SDN:L22::\S+)", 1)
    return F.when((F.size(entries) > 0) & (code != ""), code)


def map_p35_contributor_codes_p01(s: Column, p35: Column) -> Column:
    """In entries `SDN:P35::a = SDN:P01::b` separated by commas, the P01 code of this P35 code (the last one)."""
    entries = F.filter(F.split(s, ","), lambda e: F.regexp_extract(F.split_part(e, F.lit("="), F.lit(1)), r"(SDN:P35::\S+)", 1) == p35)
    code = F.regexp_extract(F.element_at(entries, -1), r"=.*?(SDN:P01::\S+)", 1)
    return F.when((F.size(entries) > 0) & (code != ""), code)


def map_call_sign_c17(df: DataFrame, call_sign: str, at: str, records: DataFrame, out: str = "c17", bucket: float = 366 * 86400.0) -> DataFrame:
    """df with the C17 code of the first record (least ordinal) of the call sign with commissioned <= at < decommissioned.

    records: call_sign, commissioned, decommissioned (seconds, null: open), ordinal, c17."""
    r = records.select(F.col("call_sign").alias(call_sign), "commissioned", "decommissioned", "ordinal", F.col("c17").alias(out))
    return first_match(df, r, call_sign, at, "commissioned", "decommissioned", "ordinal", out, bucket)
