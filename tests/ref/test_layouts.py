"""Layouts of employment sections, and the segmentation against a search of all of them."""

import random

import pytest

from docweft.operators import layouts as L


def jobs(*lines):
    return [(r["title"], r["company"], r["start"], r["end"], r["duties"]) for r in L.employment(list(lines))]


CASES = {
    "place line, page marks": (
        ["Employment Experience", "Director, Global Head of Market Links and Head of Equities Finance IT", "China", "2023 - Present", "- 1 of 3 --", "", "Executive Director, Markets Technology", "HSBC", "2019 - 2023", "- Led a platform", "- Managed delivery"],
        [("Director, Global Head of Market Links and Head of Equities Finance IT", "", "2023", "Present", []), ("Executive Director, Markets Technology", "HSBC", "2019", "2023", ["Led a platform", "Managed delivery"])],
    ),
    "place behind the title": (["Experience", "Director, Global Head of Market Links | China", "2023 - Present"], [("Director, Global Head of Market Links", "", "2023", "Present", [])]),
    "company and date in one line, wrapped duties": (
        ["PROFESSIONAL EXPERIENCE", "Director, Head of Equities & Securities Finance IT", "China", "HSBC Jun 2018 – Oct 2023", "Executive leadership role heading the delivery centre – a core component of", "the global organisation, with accountability for many engineers.", "– Defined a strategy to deepen the value within the", "organisation for years.", "-- 1 of 3 --", "Director, Global Head of FX & Head of GFX IT China", "HSBC Jan 2017 – May 2018", "– Directed a global delivery organisation."],
        [
            ("Director, Head of Equities & Securities Finance IT", "HSBC", "2018", "2023", ["Executive leadership role heading the delivery centre – a core component of the global organisation, with accountability for many engineers.", "Defined a strategy to deepen the value within the organisation for years."]),
            ("Director, Global Head of FX & Head of GFX IT China", "HSBC", "2017", "2018", ["Directed a global delivery organisation."]),
        ],
    ),
    "role groups": (
        ["PROFESSIONAL EXPERIENCE", "2018.03 - Present Hays Specialist Recruitment", "2021.07 - Present Team Manager, Corporate & Digital IT", "2018.11 - 2021.06 Senior Consultant", "2018.03 - 2018.11 Consultant", "Responsibilities:", "Talent Acquisition:", "• Delivered it.", "• Built it.", "2016.05 - 2018.01 Robert Walters China", "2016.05 - 2018.01 Consultant", "Responsibilities:", "• Conducted it."],
        [("Team Manager, Corporate & Digital IT", "Hays Specialist Recruitment", "2021", "Present", ["Delivered it.", "Built it."]), ("Senior Consultant", "Hays Specialist Recruitment", "2018", "2021", []), ("Consultant", "Hays Specialist Recruitment", "2018", "2018", []), ("Consultant", "Robert Walters China", "2016", "2018", ["Conducted it."])],
    ),
    "CJK date lines": (
        ["工作教育经历", "2016/06 --至今", "西安软通动力技术服务有限公司 | JAVA 高级工程师", "2012/05 --2016/05", "西安华为技术研究所 | JAVA 工程师", "2009/09 --2012/03", "西北大学| 硕士 | 计算机技术"],
        [("JAVA 高级工程师", "西安软通动力技术服务有限公司", "2016", "至今", []), ("JAVA 工程师", "西安华为技术研究所", "2012", "2016", [])],
    ),
    "date, company, role": (
        ["Jun 2022 – Mar 2025", "SIE Co., Ltd", "Cloud Solution Architect & Team Lead", "Led migration of systems to AWS.", "Dec 2020 – May 2022", "Intelligence Technology Co., Ltd", "Solution Architect", "Designed SaaS-based platform integrating Prometheus and Zabbix."],
        [("Cloud Solution Architect & Team Lead", "SIE Co., Ltd", "2022", "2025", ["Led migration of systems to AWS."]), ("Solution Architect", "Intelligence Technology Co., Ltd", "2020", "2022", ["Designed SaaS-based platform integrating Prometheus and Zabbix."])],
    ),
    "tildes": (["2010 ~ 2025", "PwC Service Deliver Center Shanghai", "Senior Test Manager", "2009 ~ 2010", "HP", "Testing Lead"], [("Senior Test Manager", "PwC Service Deliver Center Shanghai", "2010", "2025", []), ("Testing Lead", "HP", "2009", "2010", [])]),
    "decorated": ([" 2021.2—2021.8 一起教育科技 测试 lead", "主要工作：", "推进测试计划与交付。"], [("测试 lead", "一起教育科技", "2021", "2021", ["主要工作： 推进测试计划与交付。"])]),
    "dates inside": (
        ["Bet365 Nov 2022 - April 2025, Manchester Senior Test Engineer", "LMS August 2021— Nov 2022,Manchester Senior Engineer - QA (Contract)", "July 2022 - Feb 2025 DoorDash, San Francisco, California, USA Software Engineer"],
        [("Senior Test Engineer", "Bet365", "2022", "2025", []), ("Senior Engineer - QA (Contract)", "LMS", "2021", "2022", []), ("Software Engineer", "DoorDash", "2022", "2025", [])],
    ),
    "place behind the company": (["Jul 2021 – Mar 2022", "Slyp|Sydney,Australia", "Senior DevOps Engineer"], [("Senior DevOps Engineer", "Slyp", "2021", "2022", [])]),
    "open range": (["April 2022 –", "Intel", "Senior Infrastructure Service Engineer", "Software release system enabling and roadmap definition."], [("Senior Infrastructure Service Engineer", "Intel", "2022", "Present", ["Software release system enabling and roadmap definition."])]),
    "labels": (
        ["Time: 2019.08 – 2025.10", "Company:Tencent", "Position: iOS engineer", "Responsibility: Develop and maintain the core.", "Time: 2018.04 – 2018.12", "Company: Zhizhe Tianxia", "Position: iOS engineer", "Responsibility: Develop modules."],
        [("iOS engineer", "Tencent", "2019", "2025", ["Responsibility: Develop and maintain the core."]), ("iOS engineer", "Zhizhe Tianxia", "2018", "2018", ["Responsibility: Develop modules."])],
    ),
    "other sections first": (
        ["Current Residence", "Dalian, Liaoning", "Language", "Mandarin English", "Education", "2004.09-2008.07 Harbin Institute of Technology Bachelor’s Degree in Computing", "Certificate", "Certified Scrum Master (CSM) AFP – Associate Financial Planner", "2012.05-2024.12", "Fidelity(Dalian) Business Services Co., Ltd.", "Senior Delivery Manager", "Led the delivery of the platform."],
        [("Senior Delivery Manager", "Fidelity(Dalian) Business Services Co., Ltd.", "2012", "2024", ["Led the delivery of the platform."])],
    ),
    "one block of lines": (
        ["姓名：某人 性别：男\n基本信息\n5. 2021 年：入选代码百强\n华为技术有限公司 | 2021.10 - 至今\n（2）网络安全工程师 / DevOps 运维工程师 / Python 开发工程师\n- 担任应急响应接口人\n2. 德科（Adecco） | 2020.03 - 2021.10\nDevOps 自动化运维工程师 / Python 开发工程师"],
        [("（2）网络安全工程师 / DevOps 运维工程师 / Python 开发工程师", "华为技术有限公司", "2021", "至今", ["担任应急响应接口人"]), ("DevOps 自动化运维工程师 / Python 开发工程师", "德科（Adecco）", "2020", "2021", [])],
    ),
    "a narrative behind the role": (
        ["2019 - 2021 Lumi United Technology Co., Ltd. Android Engineer Designed and implemented a plugin for the lock module.", "Developed key features for multiple models."],
        [("Android Engineer", "Lumi United Technology Co., Ltd.", "2019", "2021", ["Designed and implemented a plugin for the lock module.", "Developed key features for multiple models."])],
    ),
    "two ranges in one line": (
        ["Ancient8 (Web3 / Gaming Platform)", "Senior DevOps Engineer | Team Lead (China)", "Dec 2022 – Mar 2024 (Led DevOps Team) Mar 2024 – Present (Sole DevOps Engineer) Shenzhen, China", "Built and operated infrastructure for services."],
        [("Senior DevOps Engineer | Team Lead (China)", "Ancient8 (Web3 / Gaming Platform)", "2022", "2024", ["Built and operated infrastructure for services."])],
    ),
    "dated tasks are no jobs": (
        ["2021.9—现在 newsbreak 测试开发组长", "主要工作：", "1）流量回放框架", "2021 使用 jmeter+jenkins 构建性能测试 job，用于 server 端 http 请求的压测任务"],
        [("测试开发组长", "newsbreak", "2021", "现在", ["主要工作： 1）流量回放框架 2021 使用 jmeter+jenkins 构建性能测试 job，用于 server 端 http 请求的压测任务"])],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(name):
    lines, want = CASES[name]
    assert jobs(*lines) == want


def every(lines, at=0, state=L.NONE):
    """Points of all ways through the lines."""
    if at == len(lines):
        yield 0.0 if state != L.GROUP else float("-inf")
        return
    for points, taken, after, _ in L.steps(lines, at, state):
        for rest in every(lines, at + taken, after):
            yield points + rest


def test_best_of_all_segmentations():
    rng, pool = random.Random(3), [x for lines, _ in CASES.values() for y in lines for x in y.split("\n") if x]
    for _ in range(120):
        lines = [L.read(rng.choice(pool)) for _ in range(rng.randint(0, 8))]
        assert abs(L.best(lines).points - max(every(lines))) < 1e-6


def test_nothing_to_read():
    assert jobs() == [] and jobs("", "  ", "plain text", "- a bullet 2019 - 2020 of a task", "2010 - 2012") == []
    assert len(jobs(*["Senior Engineer", "Some Company Ltd", "2010 - 2012", "- did it"] * 2000)) == 2000


def test_pieces_are_weighed_once():
    """A title and a company that many orders name are weighed once a worker, whatever lines they stand in (F11, F12)."""
    for f in (L.read, L.role_points, L.company_points, L._plain):
        f.cache_clear()
    for year in range(1950, 2020):
        assert jobs("Marsh Lace Engineer", f"Supplier 7 Ltd | {year} - {year + 1}")[0][:3] == ("Marsh Lace Engineer", "Supplier 7 Ltd", str(year))
    assert L.role_points.cache_info().misses < 70
    assert len(L._fitting(("d",), ("c",), ("r",))) == 1 and L._fitting((), ("c",)) == []
