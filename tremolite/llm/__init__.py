"""Operators for preparing training corpora, each written for whole tables on a cluster."""
