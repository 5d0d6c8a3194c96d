"""Timestamps as text: shape masks, one parser per mask, vectorised reading.

A text is lower-cased and its words are replaced by one symbol each (month ``@``, half of the day
``P``, zone abbreviation ``Z``, weekday ``W``, bracketed region ``R``); digits become ``9``. The
result is the text's mask. All texts of one mask have their fields at the same places, so that a
mask is compiled to slices once and every text of the mask is then read by numpy.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from fieldmark.functions.zones import ABBREVIATIONS

#: English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_MONTH = r"\b(?P<x>jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b\.?"
_DAY = r"\b(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\b\.?"
_HALF = r"(?P<x>[ap])\.?m\b\.?"
_REGION = r" ?\[(?P<x>[a-z0-9_+/-]+)\]"
_ABBREVIATION = rf"(?P<x>{'|'.join(sorted(ABBREVIATIONS, key=len, reverse=True))})$"

_DATE = (
    r"(?:W,? ?)?(?:"
    r"(?P<y1>9999)(?P<sep1>[-/.])(?P<m1>99?)(?P=sep1)(?P<d1>99?)|(?P<y2>9999)(?P<m2>99)(?P<d2>99)|"
    r"(?P<d3>99?)(?P<sep3>[-/.])(?P<m3>99?)(?P=sep3)(?P<y3>9999|99)|(?P<d4>99?)[ -]?@[ -]?(?P<y4>9999|99)|"
    r"@ ?(?P<d5>99?),? (?P<y5>9999)|(?P<y6>9999)[- ]@[- ](?P<d6>99?))"
)
_TIME = (
    r"(?:(?P<h1>99?)[:.](?P<i1>99)(?:[:.](?P<s1>99)(?:[.,](?P<f1>9+))?)?(?: ?(?P<p1>P))?|"
    r"(?P<h2>99)(?P<i2>99)(?P<s2>99)?|(?P<h3>9)(?P<i3>99)|(?P<h4>99?) ?(?P<p4>P))"
)
_ZONE = r"(?: ?(?P<z>Z)| ?(?P<sign>[-+])(?P<zh>99):?(?P<zm>99)?|(?P<r>R))?"
_SHAPES = [re.compile(x) for x in (_DATE, _TIME + _ZONE, _DATE + r"(?:t|,? )" + _TIME + _ZONE, r"(?P<e>9{10}|9{13}|9{16}|9{19})")]


@lru_cache(maxsize=4096)
def compile_mask(mask: str) -> dict[str, tuple[int, int]] | None:
    """Where each field of a mask lies, by name without the number of its form; None for no timestamp."""
    for shape in _SHAPES:
        if m := shape.fullmatch(mask):
            return {k.rstrip("0123456789"): m.span(k) for k, v in m.groupdict().items() if v is not None and not k.startswith("sep")}
    return None


def _words(texts: pa.Array, pattern: str) -> pd.Series:
    return pc.struct_field(pc.extract_regex(texts, pattern), "x").to_pandas()


def read(texts: pd.Series) -> pd.DataFrame:
    """One row for each text: day (days since 1970), sod_us (microseconds of the day), offset_s,
    region, epoch_us; a part that the text does not state, or states impossibly, is null."""
    low = pc.utf8_trim_whitespace(pc.utf8_lower(pa.Array.from_pandas(texts, type=pa.string())))
    region, month = _words(low, _REGION), _words(low, _MONTH).str[:3].map({m: k + 1 for k, m in enumerate(MONTHS)})
    s = pc.replace_substring_regex(low, _REGION, "R")
    s = pc.replace_substring_regex(pc.replace_substring_regex(s, _MONTH, "@"), _DAY, "W")
    half = _words(s, _HALF)
    s = pc.replace_substring_regex(s, _HALF, "P")
    zone = _words(s, _ABBREVIATION).map(ABBREVIATIONS)
    s = pc.replace_substring_regex(s, _ABBREVIATION, "Z")
    masks = pc.replace_substring_regex(s, "[0-9]", "9").to_pandas().to_numpy(dtype=object)
    s = s.to_pandas().to_numpy(dtype=object)
    n = len(texts)
    out = {k: np.full(n, np.nan) for k in ("day", "sod_us", "offset_s")} | {"epoch_us": np.zeros(n, dtype=np.int64), "has_epoch": np.zeros(n, dtype=bool)}
    regions = np.full(n, None, dtype=object)
    codes, distinct = pd.factorize(masks)
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(distinct)), side="right")
    begins = np.searchsorted(codes[order], np.arange(len(distinct)), side="left")
    for mask, a, b in zip(distinct, begins, ends, strict=True):
        spec = compile_mask(mask) if mask.isascii() else None
        if not spec:
            continue
        at = order[a:b]
        chars = np.array(s[at], dtype=f"S{len(mask)}").view(np.uint8).reshape(len(at), len(mask)).astype(np.int64) - 48

        def number(name: str, default: int = 0, spec=spec, chars=chars) -> np.ndarray:
            value = np.zeros(len(chars), dtype=np.int64)
            if name not in spec:
                return value + default
            for k in range(*spec[name]):
                value = value * 10 + chars[:, k]
            return value

        if "e" in spec:
            digits = spec["e"][1] - spec["e"][0]
            value = number("e")
            out["epoch_us"][at] = value * 10 ** (16 - digits) if digits <= 16 else value // 1000
            out["has_epoch"][at] = True
            continue
        if "y" in spec:
            y, d = number("y"), number("d")
            y = np.where(spec["y"][1] - spec["y"][0] == 2, y + 2000, y)
            m = number("m") if "m" in spec else month.to_numpy()[at].astype(np.int64)
            m1 = np.clip(m, 1, 12)
            first = (np.clip(y, 1, 9999) - 1970).astype("M8[Y]").astype("M8[M]") + (m1 - 1)
            length = ((first + 1).astype("M8[D]") - first.astype("M8[D]")).astype(np.int64)
            good = (y >= 1) & (m == m1) & (d >= 1) & (d <= length)
            out["day"][at] = np.where(good, first.astype("M8[D]").astype(np.int64) + d - 1, np.nan)
        if "h" in spec:
            h, i, sec = number("h"), number("i"), number("s")
            good = (i < 60) & (sec < 60) & (h < 24)
            if "p" in spec:
                good &= (h >= 1) & (h <= 12)
                h = h % 12 + 12 * (half.to_numpy()[at] == "p")
            # digits beyond the microsecond say nothing here, however many there are
            digits = min(6, spec["f"][1] - spec["f"][0]) if "f" in spec else 0
            us = number("f", 0, spec | {"f": (spec["f"][0], spec["f"][0] + digits)}) * 10 ** (6 - digits) if digits else 0
            out["sod_us"][at] = np.where(good, ((h * 60 + i) * 60 + sec) * 1_000_000 + us, np.nan)
        if "z" in spec:
            out["offset_s"][at] = zone.to_numpy(dtype=float)[at] * 60
        if "sign" in spec:
            zh, zm = number("zh"), number("zm")
            minus = chars[:, spec["sign"][0]] == ord("-") - 48
            # an offset beyond any real zone makes the text name no instant at all
            bad = (zh > 15) | (zm > 59)
            out["offset_s"][at] = np.where(minus, -1, 1) * (zh * 60 + zm) * 60
            out["sod_us"][at] = np.where(bad, np.nan, out["sod_us"][at])
        if "r" in spec:
            regions[at] = region.to_numpy(dtype=object)[at]
    return pd.DataFrame(
        {
            "day": out["day"],
            "sod_us": out["sod_us"],
            "offset_s": out["offset_s"],
            "region": regions,
            "epoch_us": pd.array(np.where(out["has_epoch"], out["epoch_us"], 0), dtype="Int64").copy() if n == 0 else pd.Series(out["epoch_us"]).where(out["has_epoch"]).astype("Int64"),
        }
    )
