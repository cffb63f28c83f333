"""Composable Spark operators for people, giving, advertising and text tables."""
