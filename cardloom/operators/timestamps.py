"""Free-form publication times to one UTC instant.

Every value becomes an array of candidate readings, one for each order of day, month and year; a Viterbi pass over each
source's record order picks the order of every record, charging for changes of it, less where the written form of the
value changes too, for dates that the order makes impossible, for jumps back in time, and a little for an order other
than the one the source declares: a declaration is a hint that the records can overrule. A value whose order is plain
takes part as well: it carries the order of the records before it and its instant stands beside theirs.

A source is cut into runs of consecutive record numbers, so that a source holding a third of all rows is as many tasks
as it needs: each run first yields the cheapest cost between any state of its first and any of its last record (3 x 3
numbers), these small matrices are chained per source, and then each run is decoded between the two states so fixed. The
result is the same as one pass over the whole source.
"""

from __future__ import annotations

import re
import zlib
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..session import materialise, table

#: Orders of an all-digit date, which are the states; PLAIN is a reading whose order of day, month and year is plain.
DMY, MDY, YMD, PLAIN = 0, 1, 2, 3
STATES = (DMY, MDY, YMD)
ORDERS = {"DMY": DMY, "MDY": MDY, "YMD": YMD}
#: Costs of a record: an order other than the declared one, and a date that its order makes impossible. Costs of a pair of
#: neighbours: another order in the same written form, in another form, and a jump back in time.
UNDECLARED, IMPOSSIBLE, SWITCH, FORM_SWITCH, BACKWARD = 0.15, 1.2, 2.0, 1.5, 0.1
BACKWARD_US = 86_400_000_000
#: Record numbers in a run; bounds what one task holds.
RUN = 50_000

# Month names in the languages of the sites.
_MONTHS = """
january february march april may june july august september october november december
januar februar märz april mai juni juli august september oktober november dezember
janvier février mars avril mai juin juillet août septembre octobre novembre décembre
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro
"""
MONTHS = {name: i + 1 for line in _MONTHS.strip().splitlines() for i, name in enumerate(line.split())}
MONTHS |= {name[:3]: MONTHS[name] for name in _MONTHS.split("\n")[1].split()} | {"sept": 9}

_ZONE = r"(?P<zone>z|(?:utc|gmt)?[+\-−]\d{1,2}(?::?\d{2})?|[a-z]{2,5})?(?:\s*\((?P<note>[^)]*)\))?(?:\[(?P<id>[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?"
_TIME = r"(?P<h>\d{1,2})(?::|h|時|시)\s?(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?|分|분)?(?:\s?(?P<ap>[ap]\.?m\.?))?(?:\s*uhr)?"
_I = re.IGNORECASE
_ISO = re.compile(rf"^(?P<y>\d{{4}})-(?P<mo>\d{{1,2}})-(?P<d>\d{{1,2}})(?:t|\s+){_TIME}\s*{_ZONE}$", _I)
_COMPACT = re.compile(rf"^(?P<y>\d{{4}})(?P<mo>\d\d)(?P<d>\d\d)t(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)(?:[.,](?P<f>\d+))?(?P<ap>)\s*{_ZONE}$", _I)
_DIGITS = re.compile(rf"^(?P<a>\d{{1,4}})\s?[/.]\s?(?P<b>\d{{1,2}})\s?[/.]\s?(?P<c>\d{{1,4}})\.?,?\s+{_TIME}\s*{_ZONE}$", _I)
_DAY_FIRST = re.compile(rf"^(?:[^\W\d]+\.?,?\s+)?(?P<d>\d{{1,2}})\.?\s+(?:de\s+)?(?P<name>[^\W\d]+)\.?,?\s+(?:de\s+)?(?P<y>\d{{4}}),?\s+(?:(?:at|à|às|um|a las)\s+)?{_TIME}\s*{_ZONE}$", _I)
_MONTH_FIRST = re.compile(rf"^(?:[^\W\d]+,?\s+)?(?P<name>[^\W\d]+)\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}),?\s+(?:at\s+)?{_TIME}\s*{_ZONE}$", _I)
_CJK = re.compile(rf"^(?P<y>\d{{4}})[年년]\s?(?P<mo>\d{{1,2}})[月월]\s?(?P<d>\d{{1,2}})[日일]\s+(?:(?P<half>午前|午後|오전|오후)\s?)?{_TIME}\s*{_ZONE}$", _I)
_LEAD = re.compile(r"^(?:posted(?:\s+on)?|published(?:\s+on)?|(?:last\s+)?updated(?:\s+on)?|on)\s*:?\s+", _I)
_EPOCH = re.compile(r"^(?:(\d{9,10})(?:\.(\d{1,9}))?|(\d{13})|(\d{16})|(\d{19}))$")
_OFFSET = re.compile(r"^(?:utc|gmt)?([+\-−])(\d{1,2}):?(\d{2})?$", _I)
_SPACE = re.compile(r"[\s ﻿]+")
_DIGIT, _LETTERS = re.compile(r"\d"), re.compile(r"[^\W\d_]+")
INFINITE, _SAME = float("inf"), list(STATES)
_EPOCH0 = datetime(1970, 1, 1, tzinfo=timezone.utc)


@lru_cache(maxsize=1024)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):
        return None


def _us(moment: datetime) -> int:
    delta = moment - _EPOCH0
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def _instant(wall: datetime, zone: str | None, zone_id: str | None, site_zone: str | None) -> tuple[int, bool] | None:
    """The instant of a wall-clock time, and whether it is the only one; None where no zone is known."""
    named = _zone(zone_id)
    if zone:
        if zone.lower() in ("z", "utc", "gmt"):
            return _us(wall.replace(tzinfo=timezone.utc)), True
        if m := _OFFSET.match(zone):
            hours, minutes = int(m[2]), int(m[3] or 0)
            if hours > 15 or minutes > 59:
                return None
            offset = timedelta(hours=hours, minutes=minutes)
            return _us(wall.replace(tzinfo=timezone.utc) - (offset if m[1] == "+" else -offset)), True
    tz = named or _zone(site_zone)
    if tz is None or (zone_id and named is None):
        return None
    first, second = wall.replace(tzinfo=tz, fold=0), wall.replace(tzinfo=tz, fold=1)
    a, b = first.utcoffset(), second.utcoffset()
    if a == b:
        return _us(first), True
    if a > b and zone:  # passed twice; the abbreviation may tell the two apart
        told = [x for x in (first, second) if (x.tzname() or "").upper() == zone.upper()]
        if len(told) == 1:
            return _us(told[0]), True
    return _us(first), False


def readings(value: str | None, site_zone: str | None) -> list[tuple[int, int, bool]]:
    """All readings of a value as (microseconds, order, fixed): one with order PLAIN, or one for every order it allows.

    Relative, impossible, empty and null values have none; a wall-clock time that is skipped, or passed twice and not
    told apart, has one that is not fixed. Two-digit years are 19xx from 70 on.
    """
    if value is None:
        return []
    text = _LEAD.sub("", _SPACE.sub(" ", value).strip())
    if m := _EPOCH.match(text):
        if m[1]:
            us = int(m[1]) * 1_000_000 + int(((m[2] or "") + "000000")[:6])
        else:
            us = int(m[3]) * 1000 if m[3] else int(m[4]) if m[4] else int(m[5]) // 1000
        return [(us, PLAIN, True)]
    m = _ISO.match(text) or _COMPACT.match(text) or _DIGITS.match(text) or _DAY_FIRST.match(text) or _MONTH_FIRST.match(text) or _CJK.match(text)
    if m is None:
        return []
    g = m.groupdict()
    hour, minute, second = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    half = g.get("half") or (g.get("ap") or "").lower().replace(".", "")
    if half:
        if not 1 <= hour <= 12 and not (hour == 0 and g.get("half")):
            return []
        hour = hour % 12 + (12 if half in ("pm", "午後", "오후") else 0)
    if hour > 23 or minute > 59 or second > 59:
        return []
    micro = int(((g["f"] or "") + "000000")[:6])
    if "a" in g:
        a, b, c = int(g["a"]), int(g["b"]), int(g["c"])
        if len(g["a"]) == 4:
            days = [(PLAIN, a, b, c)]
        elif len(g["a"]) > 2 or len(g["c"]) not in (2, 4):
            return []
        else:
            days = [(DMY, c, b, a), (MDY, c, a, b)] + ([(YMD, a, b, c)] if len(g["c"]) == 2 else [])
    else:
        month = MONTHS.get(g["name"].lower()) if g.get("name") else int(g["mo"])
        if month is None:
            return []
        days = [(PLAIN, int(g["y"]), month, int(g["d"]))]
    out = []
    for order, year, month, day in days:
        year += 0 if year > 99 else 1900 if year >= 70 else 2000
        try:
            wall = datetime.combine(date(year, month, day), datetime.min.time()).replace(hour=hour, minute=minute, second=second, microsecond=micro)
            got = _instant(wall, g["zone"], g["id"], site_zone)
        except (ValueError, OverflowError):
            continue
        if got:
            out.append((got[0], order, got[1]))
    return out


def written_form(value: str) -> int:
    """A number for the pattern and precision of a value: its digits as 0, its words as a."""
    return zlib.crc32(_LETTERS.sub("a", _DIGIT.sub("0", _SPACE.sub(" ", value).strip())).encode())


#: What the decoder needs of a record: for each state an instant (NEVER where it is impossible; a null among the numbers would
#: make them floats), whether that is fixed, and its cost; the written form; whether its order is plain.
NEVER = -(1 << 63)
RECORD = "struct<us:array<bigint>,fixed:array<boolean>,cost:array<double>,form:bigint,plain:boolean>"


def record(value: str | None, declared: str | None, site_zone: str | None) -> dict | None:
    """The record of a value; null for one without readings. A source that declares no order, or an unknown one, prefers none."""
    found = readings(value, site_zone)
    if not found:
        return None
    if found[0][1] == PLAIN:
        us, _, fixed = found[0]
        return {"us": [us] * 3, "fixed": [fixed] * 3, "cost": [0.0] * 3, "form": written_form(value), "plain": True}
    wanted, by = ORDERS.get(declared or ""), {o: (us, fixed) for us, o, fixed in found}
    cost = [(IMPOSSIBLE if o not in by else 0.0) + (UNDECLARED if wanted is not None and o != wanted else 0.0) for o in STATES]
    return {"us": [by[o][0] if o in by else NEVER for o in STATES], "fixed": [by[o][1] if o in by else False for o in STATES], "cost": cost, "form": written_form(value), "plain": False}


def _records_column(value: pd.Series, declared: pd.Series, zone: pd.Series) -> pd.DataFrame:
    clean = lambda x: x if isinstance(x, str) else None
    none = dict.fromkeys(("us", "fixed", "cost", "form", "plain"))
    return pd.DataFrame([record(clean(v), clean(d), clean(z)) or none for v, d, z in zip(value, declared, zone)], index=value.index, columns=list(none)).astype({"form": "Int64"})


def step(a: dict, i: int, b: dict, j: int) -> float:
    """Cost of state j of a record behind state i of the one before. The order doesn't change at a plain value."""
    if i != j and b["plain"]:
        return INFINITE
    turned = 0.0 if i == j else SWITCH if a["form"] == b["form"] else FORM_SWITCH
    x, y = a["us"][i], b["us"][j]
    return turned + (BACKWARD if x != NEVER and y != NEVER and y < x - BACKWARD_US else 0.0)


def _paths(records: list[dict], first: int) -> tuple[list[float], list[list[int]]]:
    """Cheapest costs to each state of the last record, from state first of the first; and the way back."""
    costs = [c if i == first else INFINITE for i, c in enumerate(records[0]["cost"])]
    back: list[list[int]] = []
    for a, b in zip(records, records[1:]):
        if b["plain"]:
            costs = [costs[j] + step(a, j, b, j) for j in STATES]
            back.append(_SAME)
            continue
        new, links = [], []
        for j in STATES:
            way = [costs[i] + step(a, i, b, j) for i in STATES]
            best = min(STATES, key=way.__getitem__)
            new.append(way[best] + b["cost"][j])
            links.append(best)
        costs = new
        back.append(links)
    return costs, back


def _in_order(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[dict]]:
    """One row per record, in record order."""
    pdf = pdf.drop_duplicates("__id").sort_values("__id", kind="stable")
    columns = ("us", "fixed", "cost", "form", "plain")
    return pdf, [{"us": list(map(int, us)), "fixed": f, "cost": c, "form": form, "plain": p} for us, f, c, form, p in zip(*(pdf[c] for c in columns))]


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, records = _in_order(pdf)
    costs = [_paths(records, i)[0] for i in STATES]
    ends = {f"{name}_{k}": [r[k]] for name, r in (("head", records[0]), ("tail", records[-1])) for k in ("us", "form", "plain")}
    return pd.DataFrame({"__source": [pdf["__source"].iloc[0]], "__run": [pdf["__run"].iloc[0]], **ends, "costs": [costs]})


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Picks the states of the first and last record of every run of a source; as Viterbi, with runs for records."""
    pdf = pdf.sort_values("__run")
    ends = {name: [{"us": list(map(int, u)), "form": f, "plain": p} for u, f, p in zip(*(pdf[f"{name}_{k}"] for k in ("us", "form", "plain")))] for name in ("head", "tail")}
    table, total = [], None
    for n, costs in enumerate(pdf["costs"]):
        enter = [(0.0, 0)] * 3
        if n:
            enter = [min((total[i] + step(ends["tail"][n - 1], i, ends["head"][n], j), i) for i in STATES) for j in STATES]
        best = [min((enter[i][0] + costs[i][j], i) for i in STATES) for j in STATES]
        table.append(([e[1] for e in enter], [i for _, i in best]))
        total = [c for c, _ in best]
    picks, j = [], min(STATES, key=lambda x: (total[x], x))
    for enter, via in reversed(table):
        i = via[j]
        picks.append((i, j))
        j = enter[i]
    picks.reverse()
    return pd.DataFrame({"__source": pdf["__source"], "__run": pdf["__run"], "first": [p[0] for p in picks], "last": [p[1] for p in picks]})


def _decode(rows: pd.DataFrame, picks: pd.DataFrame) -> pd.DataFrame:
    if rows.empty or picks.empty:
        return pd.DataFrame({"__id": pd.Series(dtype="int64"), "__us": pd.Series(dtype="int64")})
    rows, records = _in_order(rows)
    first, j = int(picks["first"].iloc[0]), int(picks["last"].iloc[0])
    _, back = _paths(records, first)
    chosen = [j]
    for links in reversed(back):
        j = links[j]
        chosen.append(j)
    chosen.reverse()
    return pd.DataFrame({"__id": rows["__id"], "__us": pd.array([r["us"][k] if r["fixed"][k] else None for r, k in zip(records, chosen)], dtype="Int64")})


def normalise_timestamps(df: DataFrame, sites: DataFrame, *, id_col: str = "card_id", value_col: str = "published_at", source_col: str = "provider", run: int = RUN) -> DataFrame:
    """(id, published_us) for every record of df whose value denotes exactly one instant.

    df needs a BIGINT id in record order, a STRING value and a STRING source; other columns don't matter, whatever
    their names. sites has provider, time_zone and date_order; a source it lacks has neither. Rows with a null id are
    dropped, repeated ids count once, a null source counts as a source of its own; an empty table gives an empty result.
    """
    known = sites.select(F.col("provider").alias("__provider"), "time_zone", "date_order").dropDuplicates(["__provider"])
    rows = (
        df.select(F.col(id_col).cast("bigint").alias("__id"), F.col(value_col).alias("__value"), F.col(source_col).alias("__src"))
        .where(F.col("__id").isNotNull() & F.col("__value").rlike("[0-9]"))
        .join(known, F.col("__src") == F.col("__provider"), "left")
        .select("__id", F.coalesce("__src", F.lit("")).alias("__source"), F.expr(f"floor(__id / {run})").cast("bigint").alias("__run"), pandas_udf(_records_column, RECORD)("__value", "date_order", "time_zone").alias("__r"))
    )
    # Parsed once: written, as both passes over the runs read it.
    rows = materialise(rows.select("__id", "__source", "__run", "__r.*")).where(F.col("us").isNotNull())
    key = "__source string, __run bigint"
    ends = ", ".join(f"{name}_us array<bigint>, {name}_form bigint, {name}_plain boolean" for name in ("head", "tail"))
    runs = rows.groupBy("__source", "__run").applyInPandas(_summary, f"{key}, {ends}, costs array<array<double>>")
    picks = runs.groupBy("__source").applyInPandas(_chain, f"{key}, first int, last int")
    return (
        rows.groupBy("__source", "__run").cogroup(picks.groupBy("__source", "__run")).applyInPandas(_decode, "__id bigint, __us bigint")
        .where(F.col("__us").isNotNull())
        .select(F.col("__id").alias(id_col), F.col("__us").alias("published_us"))
    )


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Cards whose published_at denotes exactly one instant."""
    return normalise_timestamps(table(spark, sf_dir, "cards"), table(spark, sf_dir, "sites"))
