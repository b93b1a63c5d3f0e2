"""Stored web pages in, clean ordered document collections out, on Spark."""

from pageloom.profile import CleanRules, SiteProfile

__all__ = ["CleanRules", "SiteProfile"]
