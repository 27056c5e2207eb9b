import subprocess
import sys

import pytest

from docfields.operators import rules
from tests.conftest import ROOT


def python_sections(text, bare):
    """Line by line, as the docstring says."""
    import re
    lines = text.split("\n")
    blank = lambda i: not 0 <= i < len(lines) or lines[i].strip() == ""

    def heading(i):
        x = lines[i]
        if re.fullmatch(rules.HEADING_PATTERN + ":", x):
            return x[:-1]
        if bare and (re.fullmatch(rules.CAPITALS_PATTERN, x) or re.fullmatch(rules.TITLE_PATTERN, x) and blank(i - 1) and not blank(i + 1)):
            return x.strip()
        return None

    out = [[None, []]]
    for i, x in enumerate(lines):
        h = heading(i)
        if h is None:
            out[-1][1].append(x)
        else:
            out.append([h, []])
    if len(out) > 1 and not out[0][1]:
        out = out[1:]
    joined = [(h, "\n".join(b)) for h, b in out]
    return [*joined[:-1], (joined[-1][0], re.sub("\n\\Z", "", joined[-1][1]))]


TEXTS = ["", "plain", "A:\nbody", "intro\nA:\n\nB:\nx\n", "SKILLS\na\nb\n\nWork history\nclerk\n\nno heading.\nAt all", "A:", "A:\nB:\nC:",
         "Title\n\nnot under it", "\n\nTitle\nunder it\nUSA 1\nx: y", "Total: 5\nNOTE:\nend\n\n"]


@pytest.mark.parametrize("bare", [False, True])
def test_sections_line_by_line(spark, bare):
    d = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "doc_id long, text string")
    got = {}
    for r in sorted(rules.extract_sections(d, bare=bare).collect(), key=lambda r: (r.doc_id, r.section_no)):
        got.setdefault(r.doc_id, []).append((r.heading, r.body))
    assert got == {i: python_sections(t, bare) for i, t in enumerate(TEXTS)}


ITEMS = ["Key skills (list all)", "Parties involved", "Payment terms and schedule", "Termination conditions", "Full name and contact information"]


def test_items_with_qualifiers(spark):
    text = ("Name: Ann\nPARTIES\nAnn and Bob\n\nPayment Terms\nthirty days\n\nSkills:\n- sums\n- letters\n"
            "Other:\nEither side may terminate this. Termination needs a letter.")
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r.field: (r.value, r.found_by) for r in rules.extract_fields(d, ITEMS).collect()}
    assert got == {ITEMS[0]: ("- sums\n- letters", "section"), ITEMS[1]: ("Ann and Bob", "section"),
                   ITEMS[2]: ("thirty days", "section"), ITEMS[4]: ("Ann", "label"),
                   ITEMS[3]: ("Either side may terminate this. Termination needs a letter.", "clause")}


@pytest.mark.parametrize("item, name, others", [
    ("Key skills (list all)", "key skills", ["skills"]), ("Renewal terms", "renewal terms", ["renewal"]), ("remarks", "remarks", []),
    ("Key obligations of each party", "key obligations of each party", None), ("()", "", [])])
def test_field_names(item, name, others):
    got = rules.field_names(item)
    assert got[0] == name and (others is None or got[1] == others)


def test_labels_with_marks(spark):
    labels = {"a": "Amount [USD]", "b": "A^B", "c": "C\\D", "d": "x-y (z)"}
    text = "Amount [USD]: 5\nA^B: 6\nC\\D: 7\nx-y (z): 8"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert rules.extract_key_values(d, labels).first()[1:] == ("5", "6", "7", "8")


FRESH = """
import sys
sys.path.insert(0, {root!r})
from docfields.operators import rules
from docfields.session import get_session
spark = get_session("local[1]")
n = 100_000
text = "Notes:\\n" + "\\n".join(f"line {{i}} of the notes" for i in range(n)) + "\\nEnd:\\nx"
d = spark.createDataFrame([(1, text)], "doc_id long, text string")
r = rules.extract_fields(d, ["notes"]).first()
assert r.value.count("\\n") == n - 1 and r.found_by == "section", r.found_by
assert [len(x.body.split("\\n")) for x in rules.extract_sections(d).collect()] == [n, 1]
print("read", n)
"""


def test_a_section_of_100000_lines_in_a_fresh_session():
    done = subprocess.run([sys.executable, "-c", FRESH.format(root=ROOT)], capture_output=True, text=True, timeout=300, cwd=ROOT)
    assert "read 100000" in done.stdout, done.stderr[-2000:]
