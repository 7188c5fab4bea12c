"""The analyses. Each takes DataFrames plus column names and returns a
DataFrame. Those with global windows (RFM, ranking) write their sorted rows
to the shared folder while the plan is built, and so compute their input
then; pivots without given columns find these first. All others are lazy."""

from basketry.operators.activity import active_counts, dau_wau_mau  # noqa: F401
from basketry.operators.cohort import cohort_retention  # noqa: F401
from basketry.operators.funnel import DEFAULT_STEPS, conversion_funnel, step_counts  # noqa: F401
from basketry.operators.ranking import customer_ranking, customer_spend, rank_customers  # noqa: F401
from basketry.operators.reshape import (  # noqa: F401
    pivot_cohort,
    pivot_revenue,
    quartile_profile,
    top_k_per_group,
    value_counts,
)
from basketry.operators.revenue import monthly_category, revenue_breakdown  # noqa: F401
from basketry.operators.rfm import rfm_raw, rfm_scores, rfm_segment, rfm_segmentation  # noqa: F401
from basketry.operators.summary import executive_summary, summary_dict  # noqa: F401
from basketry.operators.whatif import (  # noqa: F401
    Scenario,
    funnel_baseline,
    simulate_kpis,
    simulate_stages,
)
from basketry.operators.windows import Ordering, ntile, percent_rank, tile_columns, with_windows  # noqa: F401
