"""Spark jobs for second-hand marketplace listings: clean, classify, resolve, verify, price."""
