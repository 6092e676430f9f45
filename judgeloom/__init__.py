"""Judgeloom: paired-judgement analytics expressed as PySpark DataFrame plans."""
