"""Spark jobs for preparing and assessing software-vulnerability data."""
