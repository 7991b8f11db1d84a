"""Records from lines in their usual layouts."""

import pytest

from docweft.operators import scanners as S


def jobs(*lines):
    return [(r["title"], r["company"], r["start"], r["end"], len(r["duties"])) for r in S.employment(list(lines))]


LAYOUTS = [
    ["Director of Product | Widget Search Partners", "2022 - Present"],
    ["Director of Product", "Widget Search Partners", "2022 - Present"],
    ["2022 - Present", "Widget Search Partners", "Director of Product"],
    ["Widget Search Partners", "2022 - Present", "Director of Product"],
    ["Widget Search Partners", "Director of Product", "2022 - Present"],
    ["Director of Product", "Singapore", "Widget Search Partners | 2022 – Present"],
    ["Director of Product | Widget Search Partners | Mar 2022 ~ Present"],
    ["2022.3 - Present | Widget Search Partners | Director of Product"],
    ["Time: 2022 -", "Company: Widget Search Partners", "Position: Director of Product"],
    ["Director of Product at Widget Search Partners", "Jan2022 – present"],
]


@pytest.mark.parametrize("lines", LAYOUTS)
def test_layouts(lines):
    title, company, start, end, n = jobs(*lines, "- did one thing", "and went on", "- did another")[0]
    assert (title, company, start, end.lower(), n) == ("Director of Product", "Widget Search Partners", "2022", "present", 2)


def test_records_follow_each_other():
    got = jobs("Employment Experience", "Director of Product | Widget Search Partners", "2022 - Present", "- Leads it.", "- Partnered.", "Senior Product Manager", "Bridge Solutions", "2019 - 2022", "- Owned it.", "-- 1 of 3 --", "- Drove it.")
    assert got == [("Director of Product", "Widget Search Partners", "2022", "Present", 2), ("Senior Product Manager", "Bridge Solutions", "2019", "2022", 2)]


def test_dated_tasks_are_no_jobs():
    assert jobs("- Project lead 2019 - 2020 for something", "plain text") == []


def test_education():
    rows = S.education(["Education", "Bachelor of Business", "Example National University", "2011 - 2015", "MSc in Trade", "Sample University (UK)", "2013 - 2014", "2009 - 2013", "Other University of Science", "BS in Engineering"])
    assert [(r["degree"], r["start"], r["end"]) for r in rows] == [("Bachelor of Business", "2011", "2015"), ("MSc in Trade", "2013", "2014"), ("BS in Engineering", "2009", "2013")]
    assert S.education(["示例大学 | 本科 | 2010 - 2014"]) == [{"degree": "本科", "school": "示例大学", "start": "2010", "end": "2014"}]
    assert S.education(["won a prize", "2010 - 2011"]) == []


def test_projects():
    rows = S.projects(["Projects", "Wallet Platform (2020 - 2021) Tech Stack: Go, SQL", "- built it", "and kept on", "Indexer Service", "- did more"])
    assert [(r["name"], r["start"], r["end"], len(r["bullets"])) for r in rows] == [("Wallet Platform", "2020", "2021", 2), ("Indexer Service", "", "", 1)]


def test_profile():
    got = S.profile(["Xiao EXAMPLE (Sam)", "Shanghai, China", "Email: sam@example.com", "Phone: +86 138 0000 0000"])
    assert got == {"name": "Xiao EXAMPLE (Sam)", "email": "sam@example.com", "phone": "+86 138 0000 0000", "place": "Shanghai, China"}


def test_scan_rows(spark):
    df = spark.createDataFrame([(1, LAYOUTS[0]), (2, []), (3, None)], "doc_id bigint, lines array<string>")
    assert [(r.doc_id, r.ord, r.title) for r in S.scan(df, "employment").collect()] == [(1, 0, "Director of Product")]
    assert S.scan(df, "education").count() == 0 and S.scan(df, "projects").count() == 0


def test_results_of_a_batch_are_handed_on_bit_by_bit():
    from docweft.sources.shared import handed_on

    drawn = []
    frames = handed_on(({"a": drawn.append(i) or i, "b": None} for i in range(2500)), ["a", "b"])
    assert len(next(frames)) == 1000 and len(drawn) == 1000
    assert [len(f) for f in frames] == [1000, 500] and drawn == list(range(2500)) and list(handed_on([], ["a"])) == []


def test_lines_without_a_year_are_not_searched_for_dates(monkeypatch):
    from docweft.operators import scanners

    want = scanners.education(["BSc in Maths | Example University", "2001 - 2004"])
    assert [(r["degree"], r["start"]) for r in want] == [("BSc in Maths", "2001")]

    class Watched:
        def __init__(self, pattern):
            self.pattern, self.seen = pattern, []

        def search(self, text):
            self.seen.append(text)
            return self.pattern.search(text)

    for name in ("RANGE", "OPEN"):
        monkeypatch.setattr(scanners, name, Watched(getattr(scanners, name)))
    assert scanners.education(["BSc in Maths | Example University", "2001 - 2004"]) == want
    assert scanners.RANGE.seen == ["2001 - 2004"] and scanners.OPEN.seen == []
    # a separator that leaves one part counts for nothing
    assert scanners.read("x |").parts == ["x |"] and scanners.read("a | b, c").parts == ["a", "b, c"] and scanners.read("a, b").parts == ["a", "b"]
