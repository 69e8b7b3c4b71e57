"""DataFrame-to-DataFrame operators (cleaning, cohorts, tests, matching, ...)."""
