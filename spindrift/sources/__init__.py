"""Where tables come from and how they are kept up to date."""
