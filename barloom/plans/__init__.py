"""End-to-end jobs: the feature panel, model fitting, scoring."""
