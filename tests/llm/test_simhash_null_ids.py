from quillwork.llm.simhash import keep_one


def test_components_without_an_id_are_kept_apart(make_docs):
    rows = [(None, "one text of its own with these words"), (None, "something else that shares nothing at all"), (None, "one text of its own with these words"), (7, "the third has an id"), (None, "the third has an id")]
    kept = sorted(r["text"] for r in keep_one(make_docs(rows)).collect())
    assert kept == sorted({t for _, t in rows})
