"""Operators on frames of intervals, steps, presences, locations, schedules and timelines.

A frame's key columns say whose calendar, trace or layer a row belongs to; every operator works
for all keys at once and shuffles on them at most once for each window it needs.
"""
