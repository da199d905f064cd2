"""Profile tables, report data-quality findings and clean them reproducibly, on Spark DataFrames."""

from sieveline.options import Options
from sieveline.plans.plan import CleaningPlan
from sieveline.plans.profile import Profile, profile, register_check, unregister_check
from sieveline.plans.run import CleaningRun, clean, register_fix, unregister_fix

__all__ = [
    "CleaningPlan", "CleaningRun", "Options", "Profile", "clean", "profile", "register_check", "register_fix",
    "unregister_check", "unregister_fix",
]
