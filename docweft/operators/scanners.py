"""Records from section lines: employment, education, projects.

Employment is segmented as a whole in ``layouts``. For education and projects a line is read
once into parts: a date range and, in what is left of it, a degree, a school, a name. A record
is the run of neighbouring lines whose parts make it whole without saying anything twice, whatever
their order. What follows, up to the next record, are its bullets.

Each document is a row: its lines are folded inside the task, nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from . import records as C
from ..sources.shared import handed_on
from .layouts import employment
from .sections import known_section, squeeze

# Date ranges, places, and words of headings.
_MONTH = r"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+)?"
_POINT = rf"{_MONTH}((?:19|20)\d{{2}})(?:[./-]\d{{1,2}})?"
RANGE = re.compile(rf"(?i){_POINT}\s*(?:[–—~～-]{{1,2}}|to|至)\s*(Present|Current|Now|至今|目前|现在|{_POINT})")
OPEN = re.compile(rf"(?i){_POINT}\s*[–—~～-]{{1,2}}\s*$")
PLACE = re.compile(
    r"(?i)^(?:location\s*[:：]\s*)?(?:beijing|china|dubai|france|germany|hong kong|india|japan|london|new york|paris|san francisco|shanghai|shenzhen|singapore|sydney|tokyo|united arab emirates|united kingdom|united states|usa|uk|北京|上海|深圳|广州|杭州|香港|中国|新加坡|伦敦|纽约|东京|苏州|南京|武汉|成都|西安|厦门)(?:\s*[,，]\s*[A-Za-z一-鿿 ]+)?$"
)
LABELS = re.compile(r"(?i)^(?:time|date|period|company(?: name)?|position|job title|title|role)\s*[:：]\s*")
BULLET = re.compile(r"^(?:[-*•●◦▪■○·]|[–—])\s*|^l\s+(?=[A-Z])")
#: What parts a line, with the characters one of which a line has to have for it.
SEPARATORS = [(s, re.compile(p)) for s, p in (("|", r"\s*\|\s*"), ("t", r"\s+at\s+"), ("@", r"\s+@\s+"), ("—–-", r"\s+[—–-]\s+"), (",，", r"\s*[,，]\s*"))]
YEAR = re.compile(r"(?:19|20)\d{2}")
POINTED = re.compile(r"((?:19|20)\d{2})\s*[./]\s*(\d{1,2})(?!\d)")
GLUED = re.compile(r"(?i)\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*)(?=(?:19|20)\d{2})")
SUFFIXED = re.compile(r"(?i)\b(?:co|corp|inc|ltd|llc)\.$")
PROJECT_WORD = re.compile(r"(?i)\b(?:project|platform|system|engine|app|bot|marketplace|wallet|exchange|portal|service|framework|tool)\b|项目|系统|平台|应用|引擎")

ENDS = tuple(".。;；!?")


def _is(pattern: str) -> Callable[[str], bool]:
    found = re.compile(pattern)
    return lambda s: found.search(s) is not None


role, company, school, degree = map(_is, (C.ROLE, C.COMPANY, C.INSTITUTION, C.DEGREE))


@dataclass
class Line:
    text: str
    bullet: bool = False
    start: str = ""
    end: str = ""
    rest: str = ""
    parts: list[str] = field(default_factory=list)

    @property
    def dated(self) -> bool:
        return bool(self.start)

    @property
    def heading(self) -> bool:
        """Short, no bullet, no sentence."""
        if self.bullet or len(self.rest.split()) > 14:
            return False
        return not self.rest.endswith(ENDS) or not SUFFIXED.sub("", self.rest).endswith(ENDS)


def read(raw: str) -> Line:
    plain = squeeze(raw)
    bullet = bool(BULLET.match(plain))
    text = LABELS.sub("", BULLET.sub("", plain))
    # without a year there is no date to look for
    tidy = POINTED.sub(r"\1.\2", GLUED.sub(r"\1 ", text)) if (year := YEAR.search(text)) else text
    m = RANGE.search(tidy) if year else None
    start, end, rest = "", "", tidy
    if m:
        start, end = m[1], m[3] or m[2]
    elif year and (m := OPEN.search(tidy)) and (m.start() == 0 or tidy[m.start() - 1] in " |,("):
        start, end = m[1], "Present"
    if m:
        rest = (tidy[: m.start()].rstrip(" |,，(（–-") + " | " + tidy[m.end() :].lstrip(" |,，)）–-")).strip(" |")
    parts = []
    for signs, separator in SEPARATORS:
        parts = [p for x in (separator.split(rest) if any(s in rest for s in signs) else [rest]) if (p := x.strip())]
        if len(parts) > 1:
            break
    return Line(text, bullet, start, end, rest, [p for p in parts if not PLACE.match(p)])


def education(lines: list[str]) -> list[dict]:
    """degree, school, start, end of each record, in order."""
    rows = [x for x in map(read, lines) if x.text and not known_section(x.text)]
    out, got = [], {}

    def close() -> None:
        if got.get("degree") and got.get("school"):
            out.append({k: got.get(k, "") for k in ("degree", "school", "start", "end")})
        got.clear()

    for line in rows:
        adds: dict[str, str] = {}
        if line.heading:
            names = [p for p in line.parts if school(p)]
            titles = [p for p in line.parts if degree(p) and p not in names]
            if names and not titles and degree(re.sub(C.INSTITUTION, "", names[0])) and len(line.parts) == 1:
                # "BSc Computing Example University": the school begins at its last capitalised run
                m = re.match(r"^(.*?(?:in|of)?\s[\w ]*?)\s+((?:[A-Z][\w'-]*\s+)*(?:University|College|Institute|School)\b.*)$", names[0])
                names, titles = ([m[2]], [m[1]]) if m and degree(m[1]) else (names, titles)
            adds = ({"school": names[0]} if names else {}) | ({"degree": titles[0]} if titles else {})
        if line.dated:
            adds |= {"start": line.start, "end": line.end}
        if not adds:
            close()
            continue
        if any(k in got for k in adds):
            close()
        got |= adds
        if {"degree", "school", "start"} <= got.keys():
            close()
    close()
    return out


def projects(lines: list[str]) -> list[dict]:
    """name, start, end, bullets of each project; a heading opens one, what follows are its bullets."""
    out: list[dict] = []
    for raw in lines:
        line = read(raw)
        if not line.text or known_section(line.text):
            continue
        tech = re.match(r"(?i)^(.*?)\s*((?:使用技术|tech stack)\s*[:：].+)$", line.rest)
        name = (tech[1] if tech else line.rest).strip(" |()（）")
        opens = bool(name) and not line.bullet and line.heading and not name[0].islower() and len(name) <= 90 and not role(re.sub(PROJECT_WORD, "", name)) and (line.dated or tech is not None or PROJECT_WORD.search(name) is not None)
        if opens:
            out.append({"name": name, "start": line.start, "end": line.end, "bullets": [tech[2]] if tech else []})
        elif out:
            bullets = out[-1]["bullets"]
            if bullets and not line.bullet and (line.text[0].islower() or len(line.text) > 60):
                bullets[-1] += " " + line.text
            else:
                bullets.append(line.text)
    return out


def profile(lines: list[str]) -> dict:
    """Name, e-mail, phone and place in a document's first lines; the name is the first of twenty that can be one."""
    head = [squeeze(x) for x in lines[:20] if squeeze(x)]
    labelled = next((m[1] for x in head if (m := re.match(r"(?i)^(?:candidate|name|候选人|姓名)\s*[:：]\s*(.+)$", x))), "")
    plain = next((x for x in head if any(re.match(p, x) for p in C.NAMES) and not _is(C.HEADING)(x) and not role(x) and not company(x) and known_section(x) is None and not PLACE.match(x)), "")
    first = lambda p: next((m[0] for x in head if (m := re.search(p, x))), "")
    return {"name": labelled or plain, "email": first(r"[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}"), "phone": first(r"\+\d[\d()\s.-]{6,}\d"), "place": next((x for x in head[1:8] if PLACE.match(x)), "")}


SCHEMAS = {
    "employment": (employment, "title string, company string, start string, end string, duties array<string>"),
    "education": (education, "degree string, school string, start string, end string"),
    "projects": (projects, "name string, start string, end string, bullets array<string>"),
}


def scan(df: DataFrame, what: str) -> DataFrame:
    """df: doc_id, lines array<string> -> doc_id, ord (from 0) and the fields of each record."""
    find, schema = SCHEMAS[what]
    names = ["doc_id", "ord", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = ({"doc_id": d, "ord": n, **r} for d, lines in zip(b["doc_id"], b["lines"], strict=True) for n, r in enumerate(find([] if lines is None else [x or "" for x in lines])))
            yield from handed_on(rows, names)

    return df.select("doc_id", "lines").mapInPandas(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ord int, {schema}")
