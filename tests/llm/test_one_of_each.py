"""One row of each group of near copies stays, also among null and repeated ids."""

from rowloom.llm import jaccard


def test_null_and_repeated_ids(spark):
    text = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    near = [t + f" more{k}" for k, t in enumerate(text)]
    rows = [(None, text[0]), (None, near[0]), (5, text[1]), (5, near[1]), (3, text[2]), (5, near[2]), (None, ""), (7, None), (7, None)]
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=85).collect()]
    assert len(kept) == 5 and (3, text[2]) in kept and (None, "") in kept and (7, None) in kept
    assert sum(t in (text[0], near[0]) for _, t in kept) == 1 and sum(t in (text[1], near[1]) for _, t in kept) == 1
