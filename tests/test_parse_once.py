"""Parsed values are made once per row: no condition above a parse makes the value again."""

from procspark.sources import payloads

ROW = "<tr><td>Road <b>works</b></td><td>REF/{n}</td><td>01-02-2026</td><td>03-02-2026&nbsp;</td></tr>"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tender_cells_are_cleaned_once(spark):
    pages = spark.createDataFrame([(1, ROW.format(n=1))], "id int, html string")
    plan = plan_of(payloads.html_tender_rows(pages))
    conditions = [line for line in plan.splitlines() if "Filter" in line]
    assert conditions and not any("regexp_replace" in line for line in conditions)


def test_tender_rows_with_and_without_the_mark(spark):
    nested = ROW.format(n=2).replace("</b></td>", "</b></td>x<td>y</td>")
    plain = f"<table>{ROW.format(n=1)}\n{nested}</table>"
    odd = plain.replace("Road", "Ro\u0001ad")
    rows = payloads.html_tender_rows(spark.createDataFrame([(1, plain), (2, odd), (3, None)], "id int, html string")).orderBy("id", "at").collect()
    assert [(r.id, r.tender_id, r.description.replace("\u0001", ""), r.published_date, r.updated_at) for r in rows] == [
        (i, f"REF/{n}", text, "01-02-2026", "03-02-2026") for i in (1, 2) for n, text in ((1, "Road works"), (2, "Road works x y"))]
