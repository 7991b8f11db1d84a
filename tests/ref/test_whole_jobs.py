"""Queries over tables reach at least what the written cases in their place reach, over as many rows."""

import pytest

import oracle
from docweft import plans
from docweft.plans.cases import CASES

COLUMNS = {
    "q_employment_validity": "title_faults, company_faults, noise, score",
    "q_line_predicates": "contact, duty, heading, extractable",
    "q_place_lines": "company, place",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_all_outcomes_of_the_cases(sf, name):
    con, columns = oracle.connect(sf), COLUMNS[name]
    cases, now = CASES[name][1], plans.ORACLES[name]
    assert con.execute(f"select distinct {columns} from ({cases}) except select distinct {columns} from ({now})").fetchall() == []
    assert con.execute(f"select (select count(*) from ({now})) >= (select count(*) from ({cases}))").fetchone()[0]
