"""The SQL surface: views and checks for those who query rather than call."""
