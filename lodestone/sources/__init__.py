"""Readers for XML dumps and harvested records, and atomic table publishing."""
