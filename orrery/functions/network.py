"""Network addresses as text, by Arrow-batched calls of the standard library."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F


def _each(kind: str, f: Callable[..., Any]) -> Callable[..., Column]:
    def call(*columns: Column) -> Column:
        @F.pandas_udf(kind)
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*series, strict=True)], dtype=object)

        return run(*columns)

    return call


@lru_cache(1 << 15)
def _at(x: str) -> Any:
    """Parsed once for all functions of a batch."""
    return ipaddress.ip_interface(x)


def _short(x: Any) -> str:
    """Without the mask where it is the whole address."""
    i = _at(str(x))
    return str(i.ip) if i.network.prefixlen == i.max_prefixlen else str(i)


family = _each("int", lambda x: _at(x).version if _at(x).version == 6 else 4)
host = _each("string", lambda x: str(_at(x).ip))
masklen = _each("int", lambda x: _at(x).network.prefixlen)
netmask = _each("string", lambda x: str(_at(x).netmask))
hostmask = _each("string", lambda x: str(_at(x).hostmask))
network = _each("string", lambda x: str(_at(x).network))
broadcast = _each("string", lambda x: _short(f"{_at(x).network.broadcast_address}/{_at(x).network.prefixlen}"))
set_masklen = _each("string", lambda x, n: _short(f"{_at(x).ip}/{int(n)}"))
same_family = _each("boolean", lambda a, b: _at(a).version == _at(b).version)
contained = _each("boolean", lambda a, b: _at(a).version == _at(b).version and _at(a).network.prefixlen > _at(b).network.prefixlen and _at(a).network.subnet_of(_at(b).network))
contained_or_equal = _each("boolean", lambda a, b: _at(a).version == _at(b).version and _at(a).network.subnet_of(_at(b).network))


def _merge(a: str, b: str) -> str:
    x, y = _at(a).network, _at(b).network
    while not y.subnet_of(x):
        x = x.supernet()
    return str(x)


inet_merge = _each("string", _merge)


def _abbreviated(x: str) -> str:
    i = ipaddress.ip_network(x, strict=False)
    if i.version == 6:
        return str(i)
    octets = str(i.network_address).split(".")[: max(1, -(-i.prefixlen // 8))]
    return ".".join(octets) + f"/{i.prefixlen}"


abbrev = _each("string", _abbreviated)


def macaddr8_set7bit(mac: Column) -> Column:
    """An EUI-48 or EUI-64 address as a modified EUI-64 one."""
    digits = F.regexp_replace(F.lower(mac), "[^0-9a-f]", "")
    eight = F.when(F.length(digits) == 12, F.concat(F.substring(digits, 1, 6), F.lit("fffe"), F.substring(digits, 7, 6))).otherwise(digits)
    first = F.conv(F.substring(eight, 1, 2), 16, 10).cast("int").bitwiseOR(F.lit(2))
    whole = F.concat(F.lpad(F.lower(F.hex(first)), 2, "0"), F.substr(eight, F.lit(3), F.length(eight)))
    return F.array_join(F.regexp_extract_all(whole, F.lit("(..)")), ":")
