"""Plans that chain several operators into one job."""
