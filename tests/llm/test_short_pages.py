"""Short pages that are mostly menu and footer lose them in the pipeline's line stage; copies of a spread document stay whole."""

import corpus_pipeline


def test_boilerplate_over_half_of_a_page_goes(spark, tmp_path):
    shared = ["menu line that stands on every site " * 5, "footer line that stands on every site " * 4]
    own = [f"own text {i} " * 18 for i in range(12)]
    rows = [(i, "\n".join([shared[0], t, shared[1]]), "en", f"site{i}", 0) for i, t in enumerate(own)]
    assert all(0.5 < sum(map(len, shared)) / len(r[1]) < 0.7 for r in rows)
    rows += [(100 + i, "\n".join(shared), "en", f"site{i}", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert [got[i].text for i in range(12)] == own and all(got[i].n_chars == len(own[i]) for i in range(12))
    assert all(got[100 + i].text == "\n".join(shared) for i in range(3))
