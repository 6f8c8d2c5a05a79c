"""Table schemas and the fixed values the analytics are defined by.

Every operator takes these as parameter defaults, so a caller can re-aim a
funnel, a test or a cohort split without touching the operators.
"""

from __future__ import annotations

from pyspark.sql import types as T

USERS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("sign_up_date", T.DateType()),
        T.StructField("plan_type", T.StringType()),
        T.StructField("ab_test_group", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_timestamp", T.TimestampNTZType()),
        T.StructField("event_name", T.StringType()),
    ]
)

# --- fixed values (must equal the reference's for identical results) -------
# Event names of the product's event log.
SIGNED_UP = "signed_up"
CREATED_PROJECT = "created_project"
INVITED_TEAMMATE = "invited_teammate"
VIEWED_PRICING = "viewed_pricing_page"
UPGRADED_PLAN = "upgraded_plan"
USED_FEATURE = "used_feature_X"

# Funnel: (step number, step label, flag column, event name), in step order.
FUNNEL_STEPS: tuple[tuple[int, str, str, str], ...] = (
    (1, "Step 1: Signed Up", "signed_up", SIGNED_UP),
    (2, "Step 2: Created Project", "created_project", CREATED_PROJECT),
    (3, "Step 3: Invited Teammate", "invited_teammate", INVITED_TEAMMATE),
    (4, "Step 4: Viewed Pricing", "viewed_pricing", VIEWED_PRICING),
    (5, "Step 5: Upgraded", "upgraded", UPGRADED_PLAN),
)

# A/B test: exposure and conversion events, group labels, significance level.
AB_EXPOSURE_EVENT = VIEWED_PRICING
AB_CONVERSION_EVENT = UPGRADED_PLAN
AB_CONTROL = "A"
AB_TREATMENT = "B"
ALPHA = 0.05

# Retention: activity event, day offsets, sign-up month -> cohort label.
ACTIVITY_EVENT = USED_FEATURE
RETENTION_DAYS: tuple[int, ...] = (1, 7, 14, 30)
MONTH_COHORTS: tuple[tuple[int, str], ...] = ((1, "Jan 2024"), (2, "Feb 2024"))
BASELINE_COHORT = "Jan 2024"
COMPARISON_COHORT = "Feb 2024"
# -----------------------------------------------------------------------------
