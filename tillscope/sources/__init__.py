"""Where stars come from and where reports go."""
