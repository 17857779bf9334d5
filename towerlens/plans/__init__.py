"""End-to-end jobs: daily batch, upload scoring, rebuild after a settings change."""
