"""Plain Python versions of the dealt operators, for comparison on small inputs."""

import datetime as dt
import re
from zoneinfo import ZoneInfo

MONTH = {}
for number, names in enumerate(
    "jan january januar janvier enero|feb february februar février febrero|mar march märz mars marzo|apr april avril abril|may mai mayo|"
    "jun june juni juin junio|jul july juli juillet julio|aug august août agosto|sep sept september septembre septiembre|oct october oktober octobre octubre|"
    "nov november novembre noviembre|dec december dezember décembre diciembre".split("|")
):
    for one in names.split():
        MONTH[one] = number + 1
EPOCH = dt.datetime(1970, 1, 1)


def instant(d):
    return d.strftime("%Y-%m-%dT%H:%M:%S.%fZ").rjust(27, "0")


def norm(value, tz, order):
    if value is None:
        return None
    value = " ".join(value.split())
    if re.fullmatch(r"\d{10}", value):
        return instant(EPOCH + dt.timedelta(seconds=int(value)))
    if re.fullmatch(r"\d{13}", value):
        return instant(EPOCH + dt.timedelta(milliseconds=int(value)))
    if re.fullmatch(r"\d{4}", value):
        return value
    m = re.fullmatch(r"(\d{4})-(\d\d)", value)
    if m:
        return value if 1 <= int(m[2]) <= 12 else None
    m = re.fullmatch(r"([^\W\d_]+)\.?(?: de)? (\d{4})", value)
    if m:
        return f"{m[2]}-{MONTH[m[1].lower()]:02d}" if m[1].lower() in MONTH else None
    text = re.sub(r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), ", "", value)
    forms = [
        (r"(\d{4})([-/])(\d\d)\2(\d\d)", lambda m: (m[1], m[3], m[4])),
        (r"(\d{4})(\d\d)(\d\d)(?=T|$)", lambda m: (m[1], m[2], m[3])),
        (r"(\d\d?)([-/])(\d\d?)\2(\d{4})", lambda m: {"dmy": (m[4], m[3], m[1]), "mdy": (m[4], m[1], m[3])}.get(order)),
        (r"(\d\d?)\.(\d\d?)\.(\d{4})", lambda m: (m[3], m[2], m[1])),
        (r"(\d\d?)(?:st|nd|rd|th|\.)?(?: de)?[ -]([^\W\d_]+)\.?(?: de)?[ -](\d{4})", lambda m: (m[3], MONTH.get(m[2].lower(), 0), m[1])),
        (r"([^\W\d_]+)\.? (\d\d?)(?:st|nd|rd|th)?, (\d{4})", lambda m: (m[3], MONTH.get(m[1].lower(), 0), m[2])),
    ]
    for pattern, pick in forms:
        m = re.match(pattern, text)
        if m:
            break
    else:
        return None
    parts = pick(m)
    if not parts:
        return None
    try:
        day = dt.datetime(*map(int, parts))
    except ValueError:
        return None
    rest = text[m.end() :]
    if not rest:
        return day.strftime("%Y-%m-%d")
    m = re.fullmatch(r"(?:T|,? )(\d\d?):?(\d\d)(?::?(\d\d)(?:[.,](\d{1,6}))?)?(?: ([AP]M))?(.*)", rest)
    if not m:
        return None
    hour = int(m[1])
    if m[5]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if m[5] == "PM" else 0)
    try:
        day = day.replace(hour=hour, minute=int(m[2]), second=int(m[3] or 0), microsecond=int((m[4] or "0").ljust(6, "0")))
    except ValueError:
        return None
    zone = m[6].strip()
    if zone in ("Z", "UTC", "GMT"):
        return instant(day)
    m = re.match(r"([+-])(\d\d):?(\d\d)?", zone)
    if m:
        minutes = (int(m[2]) * 60 + int(m[3] or 0)) * (1 if m[1] == "+" else -1)
        return instant(day - dt.timedelta(minutes=minutes))
    abbreviation = None
    m = re.fullmatch(r"[\[(]?([A-Z]\w+/\w+)[\])]?", zone)
    if m:
        tz = m[1]
    elif re.fullmatch("[A-Z]{2,5}", zone):
        abbreviation = zone
    elif zone:
        return None
    if not tz:
        return None
    found = set()
    for fold in (0, 1):
        local = day.replace(tzinfo=ZoneInfo(tz), fold=fold)
        u = local.astimezone(ZoneInfo("UTC"))
        if u.astimezone(ZoneInfo(tz)).replace(tzinfo=None) == day and abbreviation in (None, local.tzname()):
            found.add(u)
    return instant(found.pop()) if len(found) == 1 else None


def gaps(intervals):
    rows = sorted((-(2**62) if a is None else a, 2**62 if b is None else b) for a, b in intervals)
    rows = [r for r in rows if r[0] < r[1]]
    out, end = [], None
    for a, b in rows:
        if end is not None and a > end:
            out.append((end, a))
        end = b if end is None else max(end, b)
    return out


def hierarchy(parents):
    """node -> (root, depth) of a dict node -> parent text."""
    clean = {n: (p or "").strip() for n, p in parents.items()}
    out = {}
    for n in clean:
        path, seen, x = [n], {n: 0}, n
        while True:
            p = clean[x]
            if not p or p not in clean:
                out[n] = (path[-1], len(path) - 1)
                break
            if p in seen:
                out[n] = (min(path[seen[p] :]), -1)
                break
            seen[p] = len(path)
            path.append(p)
            x = p
    return out


def groups(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(top)}
