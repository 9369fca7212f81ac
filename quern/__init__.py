"""Quern: a SQL dialect over keyed tables, compiled to Spark DataFrames."""
