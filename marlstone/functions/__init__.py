"""marlstone.functions"""
