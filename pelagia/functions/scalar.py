"""Scalar functions whose names or rules differ from Spark's, as SQL functions that Catalyst inlines.

Everything else in the function reference is a Spark builtin of the same name. Rules kept: concat skips nulls,
factorial(n) is 1 below 2, isnan(null) is null, division-free gcd/lcm, regexp_replace replaces the first match unless
the flag g is given, to_char takes strftime patterns, dates bins from an origin.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name(parameters) | result type | body
DEFINITIONS = r"""
gcd(a BIGINT, b BIGINT) | BIGINT | aggregate(sequence(1, 92), named_struct('a', abs(a), 'b', abs(b)), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)
lcm(a BIGINT, b BIGINT) | BIGINT | if(a = 0 OR b = 0, CAST(0 AS BIGINT), abs(a) div aggregate(sequence(1, 92), named_struct('a', abs(a), 'b', abs(b)), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a) * abs(b))
iszero(x DOUBLE) | BOOLEAN | x = 0
trunc_number(x DOUBLE, d INT DEFAULT 0) | DOUBLE | sign(x) * floor(abs(x) * power(10, d)) / power(10, d)
factorial_of(n BIGINT) | BIGINT | CASE WHEN n IS NULL THEN NULL WHEN n < 2 THEN CAST(1 AS BIGINT) ELSE factorial(CAST(n AS INT)) END
is_nan(x DOUBLE) | BOOLEAN | CASE WHEN x IS NOT NULL THEN isnan(x) END
ln_of(x DOUBLE) | DOUBLE | CASE WHEN x > 0 THEN ln(x) WHEN x = 0 THEN double('-Infinity') WHEN x IS NOT NULL THEN double('NaN') END
log2_of(x DOUBLE) | DOUBLE | CASE WHEN x > 0 THEN log2(x) WHEN x = 0 THEN double('-Infinity') WHEN x IS NOT NULL THEN double('NaN') END
log10_of(x DOUBLE) | DOUBLE | CASE WHEN x > 0 THEN log10(x) WHEN x = 0 THEN double('-Infinity') WHEN x IS NOT NULL THEN double('NaN') END
log_of(base DOUBLE, x DOUBLE) | DOUBLE | CASE WHEN x > 0 AND base > 0 AND base <> 1 THEN log(base, x) WHEN x IS NOT NULL AND base IS NOT NULL THEN double('NaN') END
float_divide(a DOUBLE, b DOUBLE) | DOUBLE | CASE WHEN b <> 0 THEN a / b WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = 0 OR isnan(a) THEN double('NaN') WHEN (a > 0) = (CAST(b AS STRING) NOT LIKE '-%') THEN double('Infinity') ELSE double('-Infinity') END
strpos(s STRING, sub STRING) | INT | instr(s, sub)
starts_with(s STRING, p STRING) | BOOLEAN | startswith(s, p)
ends_with(s STRING, p STRING) | BOOLEAN | endswith(s, p)
substr_index(s STRING, d STRING, n INT) | STRING | substring_index(s, d, n)
to_hex(n BIGINT) | STRING | lower(hex(n))
signum_of(x DOUBLE) | DOUBLE | signum(x)
today() | DATE | current_date()
datetrunc(p STRING, t TIMESTAMP_NTZ) | TIMESTAMP_NTZ | CAST(date_trunc(p, t) AS TIMESTAMP_NTZ)
date_bin(width INTERVAL DAY TO SECOND, t TIMESTAMP_NTZ, origin TIMESTAMP_NTZ) | TIMESTAMP_NTZ | CAST(timestamp_micros(unix_micros(CAST(origin AS TIMESTAMP)) + CAST(floor((unix_micros(CAST(t AS TIMESTAMP)) - unix_micros(CAST(origin AS TIMESTAMP))) / (extract(DAY FROM width) * 86400000000 + extract(HOUR FROM width) * 3600000000 + extract(MINUTE FROM width) * 60000000 + CAST(extract(SECOND FROM width) * 1000000 AS BIGINT))) AS BIGINT) * (extract(DAY FROM width) * 86400000000 + extract(HOUR FROM width) * 3600000000 + extract(MINUTE FROM width) * 60000000 + CAST(extract(SECOND FROM width) * 1000000 AS BIGINT))) AS TIMESTAMP_NTZ)
to_timestamp_seconds(n BIGINT) | TIMESTAMP_NTZ | CAST(timestamp_seconds(n) AS TIMESTAMP_NTZ)
to_timestamp_millis(n BIGINT) | TIMESTAMP_NTZ | CAST(timestamp_millis(n) AS TIMESTAMP_NTZ)
to_timestamp_micros(n BIGINT) | TIMESTAMP_NTZ | CAST(timestamp_micros(n) AS TIMESTAMP_NTZ)
to_timestamp_nanos(n BIGINT) | TIMESTAMP_NTZ | CAST(timestamp_micros(CAST(floor(n / 1000) AS BIGINT)) AS TIMESTAMP_NTZ)
from_unixtime_zone(n BIGINT, zone STRING) | TIMESTAMP_NTZ | convert_timezone('UTC', zone, timestampadd(MICROSECOND, n * 1000000, TIMESTAMP_NTZ '1970-01-01 00:00:00'))
from_unixtime_seconds(n BIGINT) | TIMESTAMP_NTZ | CAST(timestamp_seconds(n) AS TIMESTAMP_NTZ)
to_unixtime(t TIMESTAMP_NTZ) | BIGINT | unix_seconds(CAST(t AS TIMESTAMP))
to_local_time(t TIMESTAMP) | TIMESTAMP_NTZ | CAST(t AS TIMESTAMP_NTZ)
regexp_replace_first(s STRING, p STRING, r STRING) | STRING | CASE WHEN regexp_instr(s, p) > 0 THEN concat(left(s, regexp_instr(s, p) - 1), regexp_replace(regexp_substr(s, p), p, r), substr(s, regexp_instr(s, p) + length(regexp_substr(s, p)))) ELSE s END
encode_text(s STRING, f STRING) | STRING | CASE lower(f) WHEN 'hex' THEN lower(hex(CAST(s AS BINARY))) WHEN 'base64' THEN rtrim('=', base64(CAST(s AS BINARY))) END
decode_text(s STRING, f STRING) | STRING | CASE lower(f) WHEN 'hex' THEN CAST(unhex(s) AS STRING) WHEN 'base64' THEN CAST(unbase64(s) AS STRING) END
cast_int8_as_char(x TINYINT) | STRING | chr(pmod(CAST(x AS INT), 256))
map_wod_quality_flag(x BIGINT) | STRING | CASE WHEN x = 0 THEN '1' WHEN x BETWEEN 1 AND 5 THEN '3' WHEN x BETWEEN 6 AND 9 THEN '4' END
map_argo_instrument_l05(x STRING) | STRING | 'SDN:L05::130'
map_argo_platform_l06(x STRING) | STRING | 'SDN:L06::46'
map_measuring_area_type_feature_type(x STRING) | STRING | CASE WHEN contains(x, 'curve') THEN 'trajectory' WHEN contains(x, 'point') THEN 'profile' END
engine_version() | STRING | '0.1.0'
"""

#: Names that the front end turns into others: functions whose Spark namesake differs, or whose argument list does.
RENAMED = {
    "trunc": "trunc_number", "factorial": "factorial_of", "isnan": "is_nan", "encode": "encode_text", "decode": "decode_text",
    "stddev": "stddev_samp", "variance": "var_samp", "random": "rand",
    "character_length": "char_length", "ln": "ln_of", "log2": "log2_of", "log10": "log10_of",
}

_STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a",
    "j": "DDD", "a": "E", "A": "EEEE", "b": "MMM", "B": "MMMM", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "e": "d",
}


#: Codes that read one digit or more where the next character is no digit of another code.
_SHORT = {"d": "d", "m": "M", "H": "H", "I": "h", "M": "m", "S": "s", "e": "d"}


def parse_pattern(strftime: str) -> str:
    """A strftime pattern as a Java pattern for reading: numbers may lack their leading zero unless codes touch."""
    if "%" not in strftime:
        return strftime
    text = strftime.replace("%T", "%H:%M:%S").replace("%F", "%Y-%m-%d").replace("%D", "%m/%d/%y").replace("%R", "%H:%M")
    out, i, touching = "", 0, False
    while i < len(text):
        c = text[i]
        if c == "%" and i + 1 < len(text):
            if text[i + 1 : i + 3] in (":z", ".f"):
                code, i = text[i + 1 : i + 3], i + 3
                out += {":z": "xxx", ".f": "[.SSSSSS][.SSS]"}[code]
                continue
            code = text[i + 1]
            i += 2
            after = text[i : i + 1] == "%"
            if code == "%":
                out += "'%'"
            elif code == "z":
                out += "xx"
            elif code in _SHORT and not after and not touching:
                out += _SHORT[code]
            elif code in _STRFTIME:
                out += _STRFTIME[code]
            else:
                raise ValueError(f"strftime code %{code} is not supported")
            touching = True
        else:
            out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
            touching = False
            i += 1
    return out


def java_pattern(strftime: str) -> str:
    """A strftime pattern as a Java date pattern; plain letters are quoted. A pattern without % is taken as Java's."""
    if "%" not in strftime:
        return strftime
    out, i = "", 0
    while i < len(strftime):
        c = strftime[i]
        if c == "%" and i + 1 < len(strftime):
            code = strftime[i + 1]
            out += "'%'" if code == "%" else _STRFTIME.get(code, "")
            if code != "%" and code not in _STRFTIME:
                raise ValueError(f"strftime code %{code} is not supported")
            i += 2
        else:
            out += f"'{c}'" if c.isalpha() else "''" if c == "'" else c
            i += 1
    return out.replace("''", "") if "''" in out and "'" not in strftime else out


def _case(code: str, table: dict[str, str], prefix: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{prefix}{v}'" for k, v in table.items()) + " END"


def domain_definitions() -> list[str]:
    """The oceanographic functions as SQL, from the same tables and constants as their Column forms."""
    from pelagia.functions import util, vocab

    poly = str(util._ENTHALPY[-1]) + "D"
    for c in util._ENTHALPY[-2::-1]:
        poly = f"({c!r}D + p * 1e-4D * {poly})"
    b = "(9.780327D * (1D + (5.2792e-3D + 2.32e-5D * power(sin(radians(lat)), 2)) * power(sin(radians(lat)), 2)))"
    h = f"(p * 1e-4D * {poly} * 1e8D)"
    units = " ".join(f"WHEN f = '{x}' AND t = '{y}' THEN v * {k!r}D" for (x, y), k in util.UNITS.items())
    l05 = _case("b", vocab._L05, "SDN:L05::")
    l06 = _case("b", vocab._L06, "SDN:L06::")
    first = lambda v: f"CASE WHEN s RLIKE '\\\\([^)]*\\\\)' THEN concat('{v}', regexp_extract(s, '\\\\(([^)]*)\\\\)', 1)) END"
    last = "CASE WHEN s RLIKE '\\\\([^)]*\\\\)' THEN try_cast(regexp_extract(s, '(?s).*\\\\(([^)]*)\\\\)', 1) AS BIGINT) END"
    multi = "array_join(transform(regexp_extract_all(s, '\\\\(([^)]*)\\\\)', 1), x -> concat('SDN:L05::', x)), ' ')"
    entry = lambda sep, want, cut: f"try_element_at(filter(split(s, '{sep}'), e -> regexp_extract({cut}, '({want}\\\\S+)', 1) = c), -1)"
    l22 = f"nullif(regexp_extract({entry('[|]', 'SDN:P01::', 'e')}, '(SDN:L22::\\\\S+)', 1), '')"
    p35 = f"nullif(regexp_extract({entry(',', 'SDN:P35::', "split_part(e, '=', 1)")}, '=.*?(SDN:P01::\\\\S+)', 1), '')"
    out = [
        f"pressure_to_depth_teos_10(p DOUBLE, lat DOUBLE) | DOUBLE | 2D * {h} / ({b} + sqrt({b} * {b} - 4D * -0.5D * 2.26e-7D * {b} * {h}))",
        f"map_units(f STRING, t STRING, v DOUBLE) | DOUBLE | CASE {units} END",
        f"map_cmems_bigram_l05(b STRING) | STRING | {l05}",
        f"map_cmems_bigram_l06(b STRING, w STRING) | STRING | CASE WHEN b = 'CT' AND w = '995' THEN 'SDN:L06::70' ELSE {l06} END",
        f"map_cora_platform_l06(b STRING, w STRING) | STRING | {l06}",
        f"map_emodnet_chemistry_instrument_l05_multi(s STRING) | STRING | {multi}",
        f"map_emodnet_chemistry_instrument_info_l22(s STRING, c STRING) | STRING | {l22}",
        f"map_emodnet_chemistry_p35_contributor_codes_p01(s STRING, c STRING) | STRING | {p35}",
    ]
    for name in ("map_emodnet_chemistry_instrument_l05", "map_seadatanet_instrument_l05"):
        out.append(f"{name}(s STRING) | STRING | {first('SDN:L05::')}")
    for name in ("map_emodnet_chemistry_platform_l06", "map_seadatanet_platform_l06"):
        out.append(f"{name}(s STRING) | STRING | {first('SDN:L06::')}")
    for name in ("map_emodnet_chemistry_originator_edmo", "map_originator_edmo"):
        out.append(f"{name}(s STRING) | BIGINT | {last}")
    for name in vocab.LOOKUPS:  # until a vocabulary is loaded every code is unknown
        kind = "BIGINT" if name in vocab.NUMBERS else "STRING"
        out.append(f"{name}(code STRING) | {kind} | CAST(NULL AS {kind})")
    return out


def load_vocabulary(spark: SparkSession, name: str, codes: dict[str, str]) -> None:
    """Gives a lookup function its (small) code list; see vocab.Vocabulary for large ones."""
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cells = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in codes.items())
    from pelagia.functions.vocab import NUMBERS

    kind = "BIGINT" if name in NUMBERS else "STRING"
    body = f"CAST(try_element_at(map({cells}), code) AS {kind})" if codes else f"CAST(NULL AS {kind})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(code STRING) RETURNS {kind} RETURN {body}")


def register(spark: SparkSession) -> None:
    """Defines the functions in the session, once."""
    if getattr(spark, "_pelagia_scalar", False):
        return
    for line in [*DEFINITIONS.strip().splitlines(), *domain_definitions()]:
        head, kind, body = (x.strip() for x in line.split(" | ", 2))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark._pelagia_scalar = True
