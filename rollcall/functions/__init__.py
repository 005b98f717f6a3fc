from rollcall.functions import nulls, scalars, tails  # noqa: F401
