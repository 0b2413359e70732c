"""Treeline: digests of source trees and text corpora as Spark DataFrames."""
