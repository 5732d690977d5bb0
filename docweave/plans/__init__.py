"""Decisions taken from statistics before a plan is declared."""
