"""Report helpers compose the operators like the original commands."""

from lumenlog.plans import reports as R
from lumenlog.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_reports_run(spark):
    s, m = T.conversation_sessions(spark, SF), T.conversation_messages(spark, SF)
    st = R.stats_report(s, m, "model", top_n=2).collect()
    assert len(st) == 3 and st[-1].is_total and st[-1].label == "TOTAL"
    every = R.stats_report(s, m, "model", top_n=None).collect()
    assert abs(sum(r.share for r in every if not r.is_total) - 1.0) < 1e-9  # shares are over all groups
    assert sum(r.share for r in st if not r.is_total) <= 1.0
    wk = R.weekly_report(s, m).collect()
    assert [r.week for r in wk].count("TOTAL") == 1
    recent, base, spikes = R.focus_reports(s, m, "2024-01-20 00:00:00", 96, 5, stop_en=["that"])
    assert base.count() == 5 and spikes.count() <= 5
    lst = R.list_report(s, m, limit=3).collect()
    assert len(lst) == 3 and lst[0].total == s.count()
    assert R.search_report(s, m, ["the"], limit=4).count() == 4
    assert R.info_report(s).collect()[0].total_sessions == s.count()
