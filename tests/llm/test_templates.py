"""Lines that distinct documents of a host share, beside several others and beside copies."""

import random

from lectern.llm import quality


def prose(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_templates_and_copies(frame):
    r = random.Random(4)
    menu = [f"entry {k} of the menu that all pages of this site show" for k in range(8)]
    rows = [(i, "\n".join([*menu, prose(r, 90), prose(r, 80)]), "en", "few") for i in range(30)]
    rows += [(100 + i, "\n".join([*menu, prose(r, 20), prose(r, 20)]), "en", "few") for i in range(20)]
    notice = "all pages of this other site are subject to this notice"
    copied = f"{notice}\n{prose(r, 70)}"
    rows += [(1000 + i, copied, "en", "skewed") for i in range(300)]
    rows += [(2000 + i, f"{notice}\n{prose(r, 70)}", "en", "skewed") for i in range(40)]
    only = "\n".join(prose(r, 20) for _ in range(6))
    rows += [(3000 + i, only, "en", "copies") for i in range(40)]
    got = {x["doc_id"]: (x["kept"], x["removed_lines"]) for x in quality.judged(frame(rows)).collect()}
    assert {got[i] for i in range(30)} == {(True, 8)} and {got[100 + i] for i in range(20)} == {(False, 8)}
    assert {got[1000 + i] for i in range(300)} | {got[2000 + i] for i in range(40)} == {(True, 1)}
    assert {got[3000 + i] for i in range(40)} == {(True, 0)}
