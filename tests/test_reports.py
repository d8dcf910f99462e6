from sitetide.plans import catalog
from sitetide.plans.stand_ins import view

SF = "/root/testdata/sf0.001"


def test_report_has_a_row_for_each_finding(spark):
    found = view(spark, SF, "run_findings")
    assert found.filter("sitewide_pages is not null").count()
    assert catalog.queries()["report_rows"](spark, SF).count() == found.count()


def test_endings_pick_every_site_that_fits(spark):
    sites = view(spark, "/root/testdata/sf0.01", "sites").filter("not is_own and (name = 'Supplier_3' or site_id = 5 or site_id % 10 = 8)")
    assert {r[0] for r in catalog.queries()["picked_sites"](spark, "/root/testdata/sf0.01").collect()} == {r["site_id"] for r in sites.collect()}
