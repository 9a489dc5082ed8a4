"""Column functions of security codes and expert ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchange suffixes, short and standard, and the leading digits of funds.
EXCHANGES = {"SH": "XSHG", "SZ": "XSHE"}
ETF_PREFIXES = ("15", "16", "51", "52", "56", "59")


def _parts(code: Column) -> tuple[Column, Column]:
    return F.regexp_extract(code, r"^(.*)\.[^.]*$", 1), F.upper(F.regexp_extract(code, r"\.([^.]*)$", 1))


def normalize_code(code: Column) -> Column:
    """The code with the standard exchange suffix; codes of other or no exchange stay."""
    prefix, suffix = _parts(code)
    return F.coalesce(*[F.when(suffix.isin(short, long), F.concat(prefix, F.lit(f".{long}"))) for short, long in EXCHANGES.items()], code)


def denormalize_code(code: Column) -> Column:
    """The code with the short exchange suffix; codes without a standard suffix stay."""
    prefix, suffix = _parts(code)
    return F.coalesce(*[F.when(suffix == long, F.concat(prefix, F.lit(f".{short}"))) for short, long in EXCHANGES.items()], code)


def asset_type(code: Column) -> Column:
    """etf by the leading digits of a code with a suffix, else stock."""
    return F.when(code.contains(".") & F.substring(code, 1, 2).isin(*ETF_PREFIXES), "etf").otherwise("stock")


def expert_parts(expert_id: Column) -> list[Column]:
    """model_type, hyper_set, feature_set, train_window of `model_hyper_features_w<n>`; ? and 0 where there are fewer than four parts."""
    p = F.split(expert_id, "_")
    whole = F.size(p) >= 4
    names = [F.when(whole, F.get(p, F.lit(i))).otherwise("?").alias(n) for i, n in enumerate(("model_type", "hyper_set", "feature_set"))]
    window = F.when(whole, F.regexp_replace(F.get(p, F.lit(3)), "^w+", "").cast("int")).otherwise(0)
    return [*names, window.alias("train_window")]
