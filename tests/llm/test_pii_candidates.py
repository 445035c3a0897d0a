"""Candidates of the contextual method: any case, and digits in groups."""

from termloom.llm import pii


def test_hidden_emails_and_digit_groups(spark):
    texts = [
        "please email me at JOHN(AT)SITE(DOT)ORG", "please email me at john at site [dot] org", "please email me at john At site Dot org",
        "please call me under 06 12 34 56 78 now", "please call me under (06) 12-34 56 78 now", "pay with card 4111 1111 1111 1112 today", "rooms 12 and 13",
    ]
    seeds = [f"please email me at user{i}@site.org today" for i in range(60)] + [f"please call me under +4912345678{i} today" for i in range(10, 40)]
    seeds += [f"pay with card {c} now" for c in (n for n in range(4111111111110000, 4111111111110400) if pii.luhn(str(n)))]
    df = spark.createDataFrame(list(enumerate([*texts, *seeds])), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.added] for r in pii.find(df).collect() if r.added}
    assert got == {
        0: [("email", "JOHN(AT)SITE(DOT)ORG")], 1: [("email", "john at site [dot] org")], 2: [("email", "john At site Dot org")],
        3: [("phone", "06 12 34 56 78")], 4: [("phone", "(06) 12-34 56 78")], 5: [("card", "4111 1111 1111 1112")],
    }


def test_digit_groups_stay_linear():
    assert pii.others("1 " * 100_000 + "x", []) == [] and pii.others("1" * 200_000 + " 1x" * 50_000, []) == []
