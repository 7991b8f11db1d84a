"""Employment records by segmentation: the best way to read all lines of a section at once.

Each line has readings: it can name a date range, a company, a role, a place, or several of them, each
reading with the evidence for it (words of roles and companies, the shape of the text). A record is a run of
one to four heading lines in one of the LAYOUTS, or a line inside a role group, where a
dated company stands above dated roles. All other lines are duties of the record above
or belong to nothing. Every choice has points; the segmentation with the most points is found by dynamic
programming over (line, state), the states being: nothing open, a record open, roles of a group. Ties go to the way that
comes first in the order of LAYOUTS.

A line of company, role and a sentence without separators is cut in the same manner, over its words.

The fold is inside a document's row; nothing is shuffled. A section of n lines takes n times the number of layouts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from . import records as C
from .sections import known_section, squeeze, strip_rule

# Date ranges, labels of fields, places, verbs that begin a narrative.
_MONTH = r"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s*)?"
_POINT = rf"{_MONTH}(?:19|20)\d{{2}}(?:\s*[./-]\s*\d{{1,2}}(?!\d))?"
RANGE = re.compile(rf"(?i)({_POINT})\s*(?:[–—~～-]{{1,2}}|to|至)\s*(present|current|now|至今|目前|现在|{_POINT})")
OPEN = re.compile(rf"(?i)(?:^|(?<=[ |,(]))({_POINT})\s*[–—~～-]{{1,2}}\s*$")
YEAR = re.compile(r"(?:19|20)\d{2}")
FIELD_LABEL = re.compile(r"(?i)^(?:time|date|period|company(?: name)?|position|job title|title|role)\s*[:：]\s*")
PLACES = [
    "australia", "beijing", "california", "canada", "china", "dubai", "france", "germany", "hong kong", "hong kong sar", "india", "indonesia", "japan", "london", "manchester", "malaysia", "new york", "paris", "philippines", "san francisco",
    "shanghai", "shenzhen", "singapore", "sydney", "taiwan", "thailand", "tokyo", "uk", "united arab emirates", "united kingdom", "united states", "usa",
    "上海", "北京", "深圳", "广州", "杭州", "南京", "苏州", "成都", "武汉", "西安", "厦门", "香港", "香港特别行政区", "新加坡", "伦敦", "纽约", "东京", "中国", "英国", "美国", "日本",
]
VERB = re.compile(r"^(?:Architected|Built|Coordinated|Created|Delivered|Designed|Developed|Drove|Implemented|Led|Managed|Optimized|Oversaw|Responsible|Spearheaded|Supported|Worked|Wrote|负责|参与|主导|设计|实现|优化)")
BULLET = re.compile(r"^(?:[-*•●◦▪■○·–—]\s*|l\s+(?=[A-Z]))")
DECORATION = re.compile(r"^[-\s]+|^\d{1,2}[.、]\s+(?=\D)")
SUBHEADING = re.compile(r"(?i)^(?:\.|tech stack\s*:.*|(?:responsibilities|key achievements?|core expertise)\s*:?)$|^(?:[A-Z][\w&/-]*|&|and|of|the)(?:\s+(?:[A-Z][\w&/-]*|&|and|of|the)){0,5}\s*:$")

_places = re.compile(r"(?i)^(?:location\s*[:：]\s*)?(?:" + "|".join(sorted(map(re.escape, PLACES), key=len, reverse=True)) + r")(?:\s*[,，]\s*[A-Za-z一-鿿 ]+)*$")
_place_first = re.compile(r"(?i)^(?:(?:" + "|".join(sorted(map(re.escape, PLACES), key=len, reverse=True)) + r")\b[\s,，]*)+")
_two_names = re.compile(r"^[A-Z][a-z]+(?:\s[A-Z][a-z]+)?\s*,\s*(?:[A-Z][a-z]+(?:\s[A-Z][a-z]+)?)$")
_role, _company, _degree, _school = (re.compile(p) for p in (C.ROLE, C.COMPANY, C.DEGREE, C.INSTITUTION))
_name = re.compile(r"^[A-Z0-9][\w&.'’()/-]*(?:,?\s+(?:[A-Z0-9(&/][\w&.'’()/-]*|of|and|the|for))*\.?$")
_legal = re.compile(r"(?i)(?:\b(?:inc|ltd|llc|limited|corp|corporation|holdings|group|bank|recruitment|technologies|partners|solutions)\b\.?|公司|集团|银行|科技|研究所)$")

_page = re.compile(r"^-{1,2}\s*\d+ of \d+\s*-*$")
_bars, _commas = re.compile(r"\s*\|\s*"), re.compile(r"\s*[,，]\s*")
_separators = [_bars, re.compile(r"\s+at\s+|\s+@\s+"), re.compile(r"\s+[—–-]\s+"), _commas]
_behind = re.compile(r"\s*[,(（]|\s+(?:of|for|at|in|-|–|—|&|/)\s+")
_stopped, _closed = re.compile(r"[.。;；!?:：]$"), re.compile(r"[。;；!?:：]$")
_cjk_name, _one_word, _letter = re.compile(r"^[一-鿿]{2,8}(?:[（(][A-Za-z ]+[)）])?$"), re.compile(r"^\S{2,20}$"), re.compile(r"[^\W\d_]")

NONE, RECORD, GROUP = range(3)
#: Shapes of heading lines in a record: d date, c company, r role, l place; letters of one line stand in any order.
LAYOUTS = [("d", "c", "r"), ("c", "d", "r"), ("c", "r", "d"), ("cd", "r"), ("d", "cr"), ("r", "c", "d"), ("r", "cd"), ("cr", "d"), ("c", "dr"), ("cdr",), ("d", "r", "c"), ("r", "d"), ("dr",)]
LAYOUTS += [(x[0], "l", *x[1:]) for x in LAYOUTS if len(x) > 1]
MOST = max(map(len, LAYOUTS))
#: Points: a record costs something, so that weak evidence makes none; later layouts cost a little more, so that a section is read in one style.
NEW, NO_COMPANY, GROUP_HEAD, IN_GROUP, FREE, LATER = -4.0, -1.5, -2.0, -1.0, 0.5, -0.02


@dataclass(slots=True)
class Reading:
    points: float
    company: str = ""
    role: str = ""
    start: str = ""
    end: str = ""
    rest: str = ""


@dataclass(slots=True)
class Line:
    text: str
    bullet: bool = False
    readings: dict[str, Reading] = field(default_factory=dict)
    closes: bool = False  # a heading of a section, or a degree: what follows is no duty
    noise: bool = False
    duty: float = 0.0


@lru_cache(maxsize=20_000)
def is_place(s: str) -> bool:
    return _places.match(s) is not None or (_two_names.match(s) is not None and not _role.search(s) and not _company.search(s))


def _head(s: str) -> str:
    """What a title or a name ends with, before commas, brackets and what it is of."""
    return _behind.split(s, maxsplit=1)[0]


@lru_cache(maxsize=20_000)
def role_points(s: str) -> float:
    if not s or len(words := s.split()) > 18 or words[0].islower() or _stopped.search(s):
        return 0.0
    head = _head(s)
    found = list(_role.finditer(head))
    if found:
        return 4.0 if head[found[-1].end() :].strip(" .") == "" else 3.0
    return 2.5 if _role.search(s) else 0.0


@lru_cache(maxsize=20_000)
def company_points(s: str) -> float:
    if not s or len(s.split()) > 9 or is_place(s) or _closed.search(s) or VERB.match(s):
        return 0.0
    points = 3.5 if _legal.search(s.rstrip(" .")) else 3.0 if _company.search(s) else 2.0 if _name.match(s) or _cjk_name.match(s) else 1.0 if _one_word.match(s) and _letter.search(s) else 0.0
    return points - (1.5 if _role.search(s) else 0.0) if points else 0.0


def _title(s: str) -> str:
    """A title without the place in front of it."""
    return s if is_place(s) else _place_first.sub("", s)


def _cut(s: str) -> list[tuple[float, str, str, str]]:
    """(points, company, role, narrative) of words in a row: company then role, a narrative behind them."""
    words = s.split(" ")
    if not 2 <= len(words) <= 60 or not _role.search(s):
        return []
    verb = next((i for i, w in enumerate(words) if i and VERB.match(w)), len(words))
    out = []
    for a in range(1, min(verb, 9)):
        left, right = " ".join(words[:a]).rstrip(","), _title(" ".join(words[a:verb]).lstrip(",， "))
        # the name shows its end: by a word for companies, or as another script begins
        ends = (right and (left[-1].isascii() != right[0].isascii() or not left[-1].isascii())) or _legal.search(left.rstrip(" .")) or _company.search(words[a - 1])
        if ends and (c := company_points(left)) and (r := role_points(right)) and _role.search(_head(right)):
            # a title says what it is of in few words; a name is not cut inside
            out.append((c + r - 0.2 * len(right.split()) - (0.5 if not right[0].isupper() and right[0].isascii() else 0), left, right, " ".join(words[verb:])))
    return sorted(out, key=lambda x: -x[0])[:1]


@lru_cache(maxsize=10_000)
def _plain(s: str) -> dict[str, Reading]:
    """Readings of a text without a date; they are shared, so nobody may change them."""
    s = s.strip(" |,，")
    if not s:
        return {"": Reading(0.0)}
    if is_place(s):
        return {"l": Reading(1.0)}
    out: dict[str, Reading] = {}

    def add(shape: str, r: Reading) -> None:
        if r.points > 0 and (shape not in out or r.points > out[shape].points):
            out[shape] = r

    for own in ([p for p in x.split(s) if p and not is_place(p)] for x in (_bars, _commas)):
        if len(own) == 1 and own[0] != s:  # the rest are places
            add("r", Reading(role_points(own[0]), role=own[0]))
            add("c", Reading(company_points(own[0]), company=own[0]))
    add("r", Reading(role_points(_title(s)), role=_title(s)))
    add("c", Reading(company_points(s), company=s))
    for separator in _separators:
        parts = [p for p in separator.split(s) if p]
        if len(parts) < 2:
            continue
        own = [p for p in parts if not is_place(p)]
        if len(own) != 2:
            continue
        comma = separator is _commas
        for turned, (c, r) in enumerate((own, own[::-1])):
            r = _title(r)
            cp, rp = company_points(c), role_points(r)
            # behind a comma a title goes on rather than a company follows
            if cp and rp and not (role_points(c) >= 4 and not _company.search(c)) and (not comma or not turned or _company.search(c)):
                add("cr", Reading(cp + rp - (2.0 if comma and turned else 0.0), company=c, role=r))
    for points, c, r, rest in _cut(s):
        add("cr", Reading(points - 0.5, company=c, role=r, rest=rest))
    return out


def _range(s: str) -> tuple[str, str, str] | None:
    """(start, end, the rest) of a line with a date range."""
    if not YEAR.search(s):
        return None
    m = RANGE.search(s)
    if m:
        end = YEAR.search(m[2])
        before, after = s[: m.start()], s[m.end() :]
        return YEAR.search(m[1])[0], end[0] if end else m[2], f"{before.rstrip(' |,，(（–-:：')}\0{after.lstrip(' |,，)）–-')}"
    if m := OPEN.search(s):
        return YEAR.search(m[1])[0], "Present", s[: m.start()].rstrip(" |,，(（–-") + "\0"
    return None


@lru_cache(maxsize=50_000)
def read(raw: str) -> Line:
    """The readings of one line."""
    plain = squeeze(raw)
    line = Line(plain)
    if not plain or strip_rule(plain) or _page.match(plain):
        line.noise = True
        return line
    text = DECORATION.sub("", plain)
    heading = known_section(plain) is not None
    line.bullet = bool(BULLET.match(text)) and not heading
    text = BULLET.sub("", text)
    line.text = text
    labelled = FIELD_LABEL.sub("", text)
    dates = _range(labelled)
    rest = re.sub(r"\0", " | ", dates[2]).strip(" |") if dates else text
    line.noise = SUBHEADING.match(text) is not None
    line.closes = not line.noise and heading or (_degree.search(rest) is not None and (_school.search(rest) is not None or dates is not None))
    words = len(text.split())
    line.duty = (3.0 if line.bullet else 0.0) + (2.0 if words > 10 else 0.0) + (1.5 if _stopped.search(text) else 0.0) + (1.0 if VERB.match(text) else 0.0) + 0.5
    if line.bullet or line.closes or line.noise:
        return line
    if dates is None:
        line.readings = {k: r for k, r in _plain(labelled).items() if k and not (words > 18)}
        return line
    start, end, around = dates
    before, _, after = (FIELD_LABEL.sub("", x).strip() for x in around.partition("\0"))
    for other in (RANGE, re.compile(r"[(（][^()（）]*[)）]")) if RANGE.search(after) else ():
        after = other.sub(" ", after).strip()
    got: dict[str, Reading] = {}
    ways = [_plain(f"{before} | {after}" if before and after else before or after)]
    if before and after:
        left, right = _plain(before), _plain(after)
        ways.append({"cr": Reading(left["c"].points + right["r"].points, company=left["c"].company, role=right["r"].role)} if "c" in left and "r" in right else {})
        ways.append({"cr": Reading(left["r"].points + right["c"].points, company=right["c"].company, role=left["r"].role)} if "r" in left and "c" in right else {})
        ways += [left if set(right) <= {"l", ""} else {}, right if set(left) <= {"l", ""} else {}]
    for way in ways:
        for shape, r in way.items():
            key = "".join(sorted("d" + shape.replace("l", "")))
            r = Reading(r.points + 3.0, r.company, r.role, start, end, r.rest)
            if key not in got or r.points > got[key].points:
                got[key] = r
    line.readings = got
    return line


@dataclass(slots=True)
class Way:
    """How the lines up to some place are read: points, and the last step with what was before it."""

    points: float
    step: tuple | None = None  # (kind, first line, layout or None)
    before: Way | None = None


@lru_cache(maxsize=20_000)
def _fitting(*shapes: tuple[str, ...]) -> list[tuple[int, tuple[str, ...], float]]:
    """The layouts that lines of these shapes can be read in, with their own points."""
    fits = ((k, x) for k, x in enumerate(LAYOUTS) if len(x) <= len(shapes) and all(map(tuple.__contains__, shapes, x)))
    return [(k, x, NEW + LATER * k + (0.0 if any("c" in s for s in x) else NO_COMPANY)) for k, x in fits]


def begun(lines: list[Line], at: int) -> list[tuple]:
    """The records that can begin at a line."""
    near, out = [line.readings for line in lines[at : at + MOST]], []
    for k, layout, points in _fitting(*map(tuple, near)):
        for readings, shape in zip(near, layout):
            points += readings[shape].points
        out.append((points, len(layout), RECORD, ("record", at, k)))
    return out


def steps(lines: list[Line], at: int, state: int, known: list[tuple] | None = None):
    """(points, lines taken, state after, step) of all that can come at a line."""
    line = lines[at]
    # a line that is no heading: a duty where a record is open, else nothing
    if state != GROUP:
        # a date belongs to a degree below it
        apart = line.noise or line.closes or ("d" in line.readings and at + 1 < len(lines) and lines[at + 1].closes)
        yield (FREE + 4.0 if apart else line.duty if state == RECORD else FREE if not line.bullet else 3.5), 1, NONE if line.closes else state, ("line", at, None)
    # (records don't depend on the state, so the caller may know them already)
    yield from begun(lines, at) if known is None else known
    if state == GROUP:
        if (r := line.readings.get("dr")) is not None:
            points = IN_GROUP + r.points
            yield points, 1, GROUP, ("role", at, None)
            yield points, 1, RECORD, ("role", at, None)
    elif (r := line.readings.get("cd")) is not None and at + 1 < len(lines) and "dr" in lines[at + 1].readings:
        yield GROUP_HEAD + r.points, 1, GROUP, ("group", at, None)


def best(lines: list[Line]) -> Way:
    """The way with the most points through all lines; the first of equals."""
    table: list[dict[int, Way]] = [{} for _ in range(len(lines) + 1)]
    table[0][NONE] = Way(0.0)
    for at in range(len(lines)):
        known = begun(lines, at) if lines[at].readings else []
        for state, way in table[at].items():
            for points, taken, after, step in steps(lines, at, state, known):
                new = way.points + points
                old = table[at + taken].get(after)
                if old is None or new > old.points + 1e-9:
                    table[at + taken][after] = Way(new, step, way)
    ends = [w for s, w in sorted(table[-1].items()) if s != GROUP]
    return max(ends, key=lambda w: w.points) if ends else Way(0.0)


def records(lines: list[Line], way: Way) -> list[dict]:
    """Title, company, start, end and duties of the records of a way."""
    taken = []
    while way is not None and way.step is not None:
        taken.append(way.step)
        way = way.before
    out: list[dict] = []
    group, owner, fresh, open_ = "", None, False, False
    for kind, at, k in reversed(taken):
        if kind == "group":
            group, owner = lines[at].readings["cd"].company, None
        elif kind in ("record", "role"):
            shapes = LAYOUTS[k] if kind == "record" else ("dr",)
            got = [line.readings[s] for line, s in zip(lines[at : at + len(shapes)], shapes)]
            first = lambda name: next((v for r in got if (v := getattr(r, name))), "")  # noqa: B023, E731
            record = {"title": first("role"), "company": group if kind == "role" else first("company"), "start": first("start"), "end": first("end"), "duties": [x for r in got if (x := r.rest)]}
            out.append(record)
            # in a group the duties below the roles are the first role's
            owner = record if kind == "record" or owner is None else owner
            fresh, open_ = True, True
        else:
            line = lines[at]
            if line.closes:
                open_ = False
            if open_ and not line.noise and not line.closes and line.readings.keys() not in ({"l"}, {"d"}):
                if line.bullet or fresh:
                    owner["duties"].append(line.text)
                    fresh = False
                else:
                    owner["duties"][-1] += " " + line.text
    return out


def employment(lines: list[str]) -> list[dict]:
    """The records of a section's lines, in order."""
    every = [read(x) for raw in lines for x in raw.split("\n") if squeeze(x)]
    return records(every, best(every))
