"""Access rules of accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideops.functions.columns import lenient_true


def access_status(users: DataFrame, now: int) -> DataFrame:
    """Which kind of access a user has and how many days are left of each."""
    status, end = F.lower(F.trim(F.coalesce("subscription_status", F.lit("")))), F.col("subscription_current_period_end")
    comp_end, trial_end = F.col("comp_expires_at"), F.col("trial_expires_at")
    forever = comp_end.isNull() | (comp_end <= 0)
    paid = status.isin("active", "past_due") & F.coalesce(end > now, F.lit(False))
    comp = (F.col("subscription_status") == "comp") & (forever | (comp_end > now))
    trial = F.coalesce(trial_end > now, F.lit(False))
    admin = lenient_true(F.col("is_admin"))

    def days(until: Column) -> Column:
        return F.greatest(F.floor((until - now) / 86400), F.lit(0))

    df = users.select("user_id", paid.alias("paid"), F.coalesce(comp, F.lit(False)).alias("comp"), trial.alias("trial"), admin.alias("admin"),
                      F.when(paid, days(end)).alias("paid_days"), F.when(comp & ~forever, days(comp_end)).alias("comp_days"),
                      F.when(trial, days(trial_end)).alias("trial_days"))
    kind = F.when(F.col("admin"), "admin").when(F.col("comp"), "comp").when(F.col("paid"), "paid").when(F.col("trial"), "trial").otherwise("none")
    return df.withColumns({"access": kind, "has_access": kind != "none"})


def active_comps(users: DataFrame, now: int, search: str | None = None) -> DataFrame:
    """Unexpired complimentary subscriptions with days left (null for ever)."""
    kept = users.filter((F.col("subscription_status") == "comp") & (F.col("comp_expires_at").isNull() | (F.col("comp_expires_at") > now)))
    if search:
        needle = search.lower()
        kept = kept.filter(F.lower(F.coalesce("email", F.lit(""))).contains(needle) | F.lower(F.coalesce("display_name", F.lit(""))).contains(needle)
                           | F.lower(F.coalesce("comp_reason", F.lit(""))).contains(needle))
    left = F.greatest(F.floor((F.col("comp_expires_at") - now) / 86400), F.lit(0))
    return kept.select("user_id", "email", "display_name", "comp_reason", "comp_expires_at", left.alias("days_remaining"),
                       F.col("comp_expires_at").isNull().alias("is_forever"))


def campaign_audience(users: DataFrame, mailed: DataFrame, prefix: str) -> DataFrame:
    """Users of a cohort with an address who were not mailed yet."""
    cohort = users.filter(F.col("comp_reason").startswith(prefix) & (F.coalesce("email", F.lit("")) != ""))
    return cohort.join(mailed.select("user_id"), "user_id", "left_anti").select("user_id", "email", "display_name", "comp_reason")
