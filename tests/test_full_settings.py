"""Registered fits use the full settings."""

import pytest

from forecastops.catalog import models
from forecastops.plans import pipelines


class Called(Exception):
    pass


def test_second_terminal_is_fitted_with_its_full_grid(monkeypatch):
    def caught(history, series, weather, split, start, end, grid, *rest, **more):
        assert grid == pipelines.GRID_TERMINAL_B
        raise Called

    monkeypatch.setattr(models.r, "carriers_with_terminal_and_weather", lambda *a: type("Rows", (), {"select": lambda *a: None})())
    for name in ("carrier_daily", "terminal_a", "weather"):
        monkeypatch.setattr(models.t, name, lambda *a: None)
    monkeypatch.setattr(models.pl, "prepare_series", lambda *a: None)
    monkeypatch.setattr(models.pl, "series_forecast", caught)
    with pytest.raises(Called):
        models.fc_series_terminal_b(None, None)
