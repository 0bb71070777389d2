"""DataFrame -> DataFrame operators of the survey inventory (section 2)."""
